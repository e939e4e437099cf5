"""Fill-in-middle transformation as one pyarrow.compute pipeline per batch.

A text is cut into units (lines with their end); two seeded hashes of its id choose
where the middle begins and ends, two more whether it is rearranged and how. Which
piece a unit goes to follows from its place among its text's units alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
FIM_PERCENT = 100  # of the texts are rearranged
SPM_PERCENT = 50  # of those with the suffix first
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")
_EMPTY, _LINE_END = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
BATCH_BYTES = 16 << 20  # of text that the pipeline takes at once; a longer text is taken alone


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers that follow from a seed and an id; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _modulo(a: pa.Array, b: pa.Array | int) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def units(texts: pa.Array) -> pa.Array:
    """Each text's units, ``[^\\n]*\\n|[^\\n]+`` from left to right, as a list; of an empty text none."""
    lists = pc.split_pattern(texts, "\n")
    lines, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    last = pc.equal(_ordinals(lists, parent), pc.subtract(pc.take(pc.list_value_length(lists), parent), 1))
    whole = pc.binary_join_element_wise(lines, pc.if_else(last, _EMPTY, _LINE_END), _EMPTY)
    kept = pc.or_(pc.invert(last), pc.not_equal(lines, ""))
    return _lists(pc.filter(whole, kept), pc.filter(parent, kept), len(texts))


def _ordinals(lists: pa.Array, parent: pa.Array) -> pa.Array:
    """Place (0, 1, 2 ...) of every flattened value within its list."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    begins = pc.subtract(pc.cumulative_sum(lengths), lengths)
    return pc.subtract(pa.array(np.arange(len(parent), dtype=np.int64)), pc.take(begins.cast(pa.int64()), parent))


def _lists(values: pa.Array, parent: pa.Array, n: int) -> pa.Array:
    """Values put together as lists again, ``n`` of them, some maybe empty; parents ascend."""
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(parent.to_numpy(zero_copy_only=False), minlength=n), out=offsets[1:])
    return pa.LargeListArray.from_arrays(pa.array(offsets), values)


def rearranged(texts: pa.Array, h: list[pa.Array], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> dict[str, pa.Array]:
    """The added columns of a batch of texts without nulls and their four draws."""
    lists = units(texts)
    n = pc.list_value_length(lists)
    cuts = [_modulo(x, pc.add(n, 1)) for x in h[:2]]
    first, second = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    place = _ordinals(lists, parent)
    in_prefix, in_suffix = pc.less(place, pc.take(first, parent)), pc.greater_equal(place, pc.take(second, parent))
    roles = {"prefix": in_prefix, "middle": pc.invert(pc.or_(in_prefix, in_suffix)), "suffix": in_suffix}
    piece = {role: pc.binary_join(_lists(pc.filter(flat, mask), pc.filter(parent, mask), len(texts)), _EMPTY) for role, mask in roles.items()}

    plain = pc.or_(pc.equal(texts, ""), pc.greater_equal(_modulo(h[2], 100), fim_percent))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    spm = pc.less(_modulo(h[3], 100), spm_percent)
    p, s, m = (pa.scalar(x, pa.large_string()) for x in (PREFIX, SUFFIX, MIDDLE))
    psm_form = pc.binary_join_element_wise(p, piece["prefix"], s, piece["suffix"], m, piece["middle"], _EMPTY)
    spm_form = pc.binary_join_element_wise(s, piece["suffix"], p, piece["prefix"], m, piece["middle"], _EMPTY)
    chars = {role: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(piece[role]).cast(pa.int64())) for role in ("prefix", "middle")}
    return {
        "n": n.cast(pa.int64()), "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")), "prefix_chars": chars["prefix"], "middle_chars": chars["middle"],
        "output": pc.if_else(plain, texts, pc.if_else(spm, spm_form, psm_form)),
    }


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch cut where its texts reach ``BATCH_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, first = np.cumsum(sizes), 0
    while first < batch.num_rows:
        before = total[first] - sizes[first]
        end = max(first + 1, int(np.searchsorted(total, before + BATCH_BYTES, "right")))
        yield batch.slice(first, end - first)
        first = end


def fill_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Every row of ``docs`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``, the text in that form.

    A text that is empty, or holds one of the three marks, stays plain: the marks of an
    output are always its own, and ``restored`` gives the text back exactly. Null texts
    count as empty. Rows are independent: repeated ids draw alike, a null id draws as an
    empty one, an empty table gives an empty result, and nothing is shuffled. Columns of
    ``docs`` that are named like those added are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ADDED or c == text]
    names = [fresh(f"_h{k}", docs.columns) for k in range(4)]
    rows = docs.select(*kept, *[d.alias(name) for d, name in zip(draws(F.col(key), seed), names, strict=True)])
    at = kept.index(text)
    out = [c for c in kept if c.lower() not in ADDED]
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([docs.schema[c] for c in out] + [T.StructField(a, k) for a, k in zip(ADDED, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, at):
                texts = pc.fill_null(part.column(at).cast(pa.large_string()), "")
                added = rearranged(texts, [part.column(len(kept) + k) for k in range(4)], fim_percent, spm_percent)
                added["output"], added["form"] = added["output"].cast(pa.string()), added["form"].cast(pa.string())
                yield pa.record_batch([part.column(kept.index(c)) for c in out] + [added[a] for a in ADDED], names=[*out, *ADDED])

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from outputs and the texts restored from them."""
    rows = fill_middle(docs.select("doc_id", "text"))
    sha = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sha)
