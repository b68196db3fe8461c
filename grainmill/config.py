"""Run recipe: which operators a preparation job uses, checked when it is made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

MODES = ("pretrain", "instruct", "preference")
# Keys of a recipe's data section that steer training alone.
TRAINING_ONLY = {"tokenizer_model_path"}
SAMPLE_MODES = ("truncation", "none", "sample", "split")


@dataclass(frozen=True)
class PrepConfig:
    mode: str
    # Not used by preference recipes, whose rows stay text.
    seq_length: int | None = None
    data: Mapping[str, str] | None = None
    pad_to_max: bool = True
    sequence_sample_mode: str = "truncation"
    concat_multiple_sequence: bool = False
    num_sequences: int | None = None
    split_by_shard: bool = False
    seed: int = 42
    # How many independent readers the rows are dealt to. Packing never crosses a reader, so
    # this changes results and is part of the recipe, unlike the number of Spark partitions.
    num_shards: int = 1
    world_size: int = 1
    train_batch_size: int = 1
    # Preference recipes: only the first rows, and pairs of at most so many characters.
    sanity_check: bool = False
    max_pair_chars: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"dataset mode {self.mode!r} not found, expected one of {MODES}")
        if self.sequence_sample_mode not in SAMPLE_MODES:
            raise ValueError(f"unknown sequence_sample_mode {self.sequence_sample_mode!r}")
        if self.seq_length is None and self.mode != "preference":
            raise ValueError("seq_length is missing")
        for name in ("seq_length", "num_shards", "world_size", "train_batch_size", "max_pair_chars"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.mode != "preference" and (self.sanity_check or self.max_pair_chars is not None):
            raise ValueError("sanity_check and max_pair_chars belong to preference recipes")
        if self.mode == "preference" and self.concat_multiple_sequence:
            raise ValueError("preference recipes are not packed")
        packs = self.concat_multiple_sequence
        if packs and (self.num_sequences is None or self.num_sequences < 1):
            raise ValueError("concat_multiple_sequence needs num_sequences")
        if self.sequence_sample_mode == "sample" and not (self.pad_to_max or packs):
            raise ValueError("sample mode needs pad_to_max or concat_multiple_sequence")
        if self.sequence_sample_mode == "split" and packs:
            raise ValueError("split mode excludes concat_multiple_sequence")
        # Labels of instruction rows are made per row before shaping; anything that moves or
        # overwrites ids afterwards would leave ids and labels of different rows side by side.
        if self.mode == "instruct" and (
            packs or self.sequence_sample_mode not in ("truncation", "none")
        ):
            raise ValueError("instruct mode allows truncation or none, without packing")

    @classmethod
    def from_dict(cls, recipe: Mapping) -> "PrepConfig":
        """Build from a recipe with a ``data`` section and, optionally, a ``train`` section.

        A key of the data section that is not known is an error, so a misspelt one is found.
        """
        known = {f.name for f in fields(cls)}
        section = recipe["data"]
        unknown = set(section) - known - TRAINING_ONLY
        if unknown:
            raise ValueError(f"unknown keys in the recipe: {sorted(unknown)}")
        values = {k: v for k, v in section.items() if k in known}
        train = recipe.get("train") or {}
        values.update({k: train[k] for k in ("train_batch_size",) if k in train})
        return cls(**values)

    @classmethod
    def from_yaml(cls, path: str) -> "PrepConfig":
        import yaml

        with open(path, encoding="utf-8") as fp:
            return cls.from_dict(yaml.safe_load(fp))
