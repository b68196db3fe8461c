"""Text templates and the code-point tokeniser, as Column functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from grainmill.constants import (
    EOS,
    FIRST_BYTE_ID,
    INSTRUCT_INPUT,
    INSTRUCT_NO_INPUT,
    PREFERENCE_PROMPT,
)
from grainmill.functions.steps import text_steps

# Unicode white space, and the four separator controls that Python strips as well.
SPACE = r"(?U:[\s\x1c-\x1f])"


def fill(template: str, **parts: Column) -> Column:
    """``str.format`` with Columns for the named fields."""
    pieces = re.split(r"\{(\w+)\}", template)
    cols = [parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p]
    return F.concat(*cols)


def instruct_sample(instruction: Column, output: Column) -> Column:
    """Rendered text and answer of one exchange; the answer is a suffix of the text."""
    return F.struct(
        fill(INSTRUCT_NO_INPUT, instruction=instruction, output=output).alias("text"),
        F.concat(output, F.lit(EOS)).alias("answer"),
    )


def instruct_input_sample(instruction: Column, input_: Column, output: Column) -> Column:
    """Like ``instruct_sample`` for an exchange that comes with extra input."""
    text = fill(INSTRUCT_INPUT, instruction=instruction, input=input_, output=output)
    return F.struct(text.alias("text"), F.concat(output, F.lit(EOS)).alias("answer"))


def preference_prompt(question: Column) -> Column:
    return fill(PREFERENCE_PROMPT, question=question)


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def code_points(text: Column) -> Column:
    """One token per character: its code point, moved above the ids of the special tokens."""
    chars = F.split(text, "")
    ids = F.transform(chars, lambda c: F.ascii(c) + F.lit(FIRST_BYTE_ID))
    return F.when(F.length(text) > 0, ids).otherwise(F.array().cast("array<int>"))


def _points(texts: pa.Array) -> pa.ListArray:
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
    joined = "".join(filter(None, texts.to_pylist()))
    ids = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.int32) + FIRST_BYTE_ID
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))


def points_by_steps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield from map(_points, text_steps(batch))


def text_points(text: Column) -> Column:
    """``code_points`` of a whole column in one Arrow step.

    It takes a fraction of the time and is made once, however often a plan uses it. It cannot be
    used inside array functions; ``code_points`` can. Null gives no tokens, as there. A task holds
    the ids of one step of text at a time.
    """
    return F.arrow_udf(points_by_steps, "array<int>")(text)


def words(text: Column) -> Column:
    """Words between white space, with no empty ones."""
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")


def source_tag(path: Column) -> Column:
    """Source name from a file name such as ``part-<source>-01.jsonl``; null if there is none."""
    return F.try_element_at(F.split(path, "-"), F.lit(-2))
