"""Whole recipes on files without keys: every row has one place, and a second run the same one."""

import json

import pytest

from grainmill import PrepConfig
from grainmill.functions.text import code_points
from grainmill.plans import prepare


def write(folder, name, records):
    with open(folder / name, "w") as file:
        file.writelines(json.dumps(r) + "\n" for r in records)


def run(spark, folder, mode, **recipe):
    data = {"mode": mode, "world_size": 2, "data": {"a": f"{folder}/part-a-*.jsonl", "b": f"{folder}/part-b-*.jsonl"}}
    cfg = PrepConfig.from_dict({"data": {**data, **recipe}, "train": {"train_batch_size": 3}})
    return sorted(
        (tuple(r.asDict().items()) for r in prepare.run(spark, cfg, code_points).collect()), key=repr
    )


def places(rows):
    rows = [dict(r) for r in rows]
    return sorted((r["rank"], r["batch_id"]) for r in rows)


@pytest.mark.parametrize("shards", [False, True])
def test_instruction_records_without_keys(spark, tmp_path, shards):
    same = {"instruction": "i", "input": "", "output": "o", "history": [["p", "q"], ["p", "q"]]}
    write(tmp_path, "part-a-0.jsonl", [same, same, {**same, "output": None}])
    write(tmp_path, "part-b-0.jsonl", [{**same, "input": "x"}])
    rows = run(spark, tmp_path, "instruct", seq_length=64, split_by_shard=shards, num_shards=4)
    assert len(rows) == 2 * 3 + 2 + 1  # two records of three turns, one without an output, one with an input
    assert rows == run(spark, tmp_path, "instruct", seq_length=64, split_by_shard=shards, num_shards=4)
    keys = {(dict(r)["row_key"], dict(r)["turn"]) for r in rows}
    assert len(keys) == len(rows)
    if not shards:
        assert places(rows) == sorted((p % 2, p // 2 // 3) for p in range(len(rows)))


def test_split_texts_without_keys(spark, tmp_path):
    write(tmp_path, "part-a-0.jsonl", [{"text": "x" * 20}] * 5)
    write(tmp_path, "part-b-0.jsonl", [{"text": "abcdefghij"}, {"text": "short"}])
    rows = run(spark, tmp_path, "pretrain", seq_length=8, sequence_sample_mode="split", pad_to_max=False)
    assert len(rows) == 5 * 2 + 1 and rows == run(
        spark, tmp_path, "pretrain", seq_length=8, sequence_sample_mode="split", pad_to_max=False
    )
    assert places(rows) == sorted((p % 2, p // 2 // 3) for p in range(11))


def test_preference_pairs_without_keys(spark, tmp_path):
    pair = {"question": "q", "response_j": "better", "response_k": "worse"}
    write(tmp_path, "part-a-0.jsonl", [pair] * 4 + [{**pair, "response_k": None}])
    write(tmp_path, "part-b-0.jsonl", [{**pair, "response_j": "long " * 50}])
    rows = [dict(r) for r in run(spark, tmp_path, "preference", max_pair_chars=60)]
    assert len(rows) == 4 and {r["prompt"] for r in rows} == {"### Instruction: q\n\n### System: \n"}
    assert len(run(spark, tmp_path, "preference")) == 5


def test_broken_lines_stop_a_recipe(spark, tmp_path):
    (tmp_path / "part-a-0.jsonl").write_text("{broken\n")
    write(tmp_path, "part-b-0.jsonl", [{"text": "x"}])
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        run(spark, tmp_path, "pretrain", seq_length=8)
