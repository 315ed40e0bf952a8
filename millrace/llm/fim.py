"""Fill-in-middle: each text is cut at two of its units by a streaming matcher."""

from __future__ import annotations

import re
from collections import deque
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import set_aside

#: A unit is a word with the white space before it; white space at the end is one unit.
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Columns that ``fill_in_middle`` adds.
NEW = ("n_units", "form", "prefix_chars", "middle_chars", "fim_text")


def count_units(text: str) -> int:
    """First pass: the matcher runs to the end and only the last number is kept."""
    last = deque(enumerate(UNIT.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def unit_ends(text: str, *ranks: int) -> list[int]:
    """Second pass: code points before the end of so many units, for ascending ranks.

    One lazy matcher is advanced from rank to rank and stops at the last; only the latest
    match is held.
    """
    matches, at, end, ends = UNIT.finditer(text), 0, 0, []
    for rank in ranks:
        for m in deque(islice(matches, rank - at), maxlen=1):
            end = m.end()
        at = rank
        ends.append(end)
    return ends


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the sha256 of ``<seed>:<doc_id>``; a null id is ''."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` turned into ``output``."""
    behind = lambda mark: F.substring_index(output, mark, -1)
    middle = behind(MIDDLE)
    psm = F.concat(F.substring_index(behind(PREFIX), SUFFIX, 1), middle, F.substring_index(behind(SUFFIX), MIDDLE, 1))
    spm = F.concat(F.substring_index(behind(PREFIX), MIDDLE, 1), middle, F.substring_index(behind(SUFFIX), PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows with n_units, form, prefix_chars, middle_chars and fim_text.

    ``rate`` per cent of the texts are cut into prefix, middle and suffix at two units drawn
    from the id, ``spm`` per cent of these with the suffix first.  Empty texts and those that
    hold a mark stay plain.  Null text is empty, a null id draws like an empty one, rows of one
    id draw the same numbers, an empty table gives an empty result.  Columns called like a new
    one are kept under the names of ``set_aside``.  Texts go through Python one at a time; a
    task holds a batch of Arrow rows, one text and one match, never a list of units.
    """
    aside = set_aside(docs, NEW)
    work = docs.withColumnsRenamed(aside)
    whole = F.coalesce(F.col(f"`{aside.get(text, text)}`"), F.lit(""))
    h = draws(F.col(f"`{aside.get(doc_id, doc_id)}`"), seed)
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    plain = (whole == "") | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    held = work.select(F.struct(*(F.col(f"`{c}`") for c in work.columns)).alias("held"), whole.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    schema = held.select("held", "text", "form", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b")).schema

    def cut(batches):
        for batch in batches:
            n, a, b = [], [], []
            for t, kind, h1, h2 in zip(*(batch.column(k) for k in ("text", "form", "h1", "h2")), strict=True):
                t = t.as_py()
                n.append(count_units(t))
                ends = (None, None)
                if kind.as_py() != "plain":
                    ends = unit_ends(t, *sorted(h.as_py() % (n[-1] + 1) for h in (h1, h2)))
                a.append(ends[0])
                b.append(ends[1])
            new = [pa.array(x, pa.int64()) for x in (n, a, b)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("held", "text", "form")), *new], ["held", "text", "form", "n", "a", "b"])

    out = held.mapInArrow(cut, schema)
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    pre, mid, suf = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    made = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), pre, F.lit(SUFFIX), suf, F.lit(MIDDLE), mid))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suf, F.lit(PREFIX), pre, F.lit(MIDDLE), mid))
        .otherwise(F.col("text"))
    )
    return out.select("held.*", F.col("n").alias("n_units"), "form", F.col("a").alias("prefix_chars"), (F.col("b") - F.col("a")).alias("middle_chars"), made.alias("fim_text"))
