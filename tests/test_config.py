import pytest

from grainmill import PrepConfig


def make(**changes):
    return PrepConfig(**{"mode": "pretrain", "seq_length": 8, **changes})


@pytest.mark.parametrize(
    "changes",
    [
        {"mode": "other"},
        {"sequence_sample_mode": "other"},
        {"sequence_sample_mode": "sample", "pad_to_max": False},
        {"sequence_sample_mode": "split", "concat_multiple_sequence": True, "num_sequences": 2},
        {"concat_multiple_sequence": True},
        {"mode": "instruct", "sequence_sample_mode": "split"},
        {"mode": "instruct", "sequence_sample_mode": "sample"},
        {"mode": "instruct", "concat_multiple_sequence": True, "num_sequences": 2},
        {"seq_length": 0},
    ],
)
def test_bad_recipes_are_refused(changes):
    with pytest.raises(ValueError):
        make(**changes)


def test_defaults_and_good_recipes():
    assert make().pad_to_max and make().sequence_sample_mode == "truncation"
    make(sequence_sample_mode="sample", pad_to_max=False, concat_multiple_sequence=True,
         num_sequences=2)


def test_from_yaml(tmp_path):
    path = tmp_path / "recipe.yaml"
    path.write_text(
        "data:\n  mode: pretrain\n  data:\n    a: 'x/*.jsonl'\n  pad_to_max: False\n"
        "  sequence_sample_mode: none\n  concat_multiple_sequence: True\n  num_sequences: 10\n"
        "  seq_length: 600\n  tokenizer_model_path: ignored\n"
        "train:\n  train_batch_size: 24\n  lr: 1.0e-4\n"
    )
    cfg = PrepConfig.from_yaml(str(path))
    assert (cfg.seq_length, cfg.num_sequences, cfg.train_batch_size) == (600, 10, 24)
    assert cfg.data == {"a": "x/*.jsonl"} and not cfg.pad_to_max


def test_misspelt_keys_are_refused():
    recipe = {"data": {"mode": "pretrain", "seq_length": 8, "pad_to_maxx": True}}
    with pytest.raises(ValueError, match="pad_to_maxx"):
        PrepConfig.from_dict(recipe)


def test_preference_recipes():
    cfg = PrepConfig(mode="preference", sanity_check=True, max_pair_chars=100)
    assert cfg.seq_length is None
    for bad in (
        {"mode": "pretrain"}, {"mode": "instruct", "seq_length": 8, "sanity_check": True},
        {"mode": "pretrain", "seq_length": 8, "max_pair_chars": 5}, {"mode": "preference", "max_pair_chars": 0},
        {"mode": "preference", "concat_multiple_sequence": True, "num_sequences": 2},
    ):
        with pytest.raises(ValueError):
            PrepConfig(**bad)
