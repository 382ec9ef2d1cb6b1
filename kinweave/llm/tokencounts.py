"""Edit-aware token counts from pre-token segment trees.

A document's text is cut into units (a run of white space and what follows it), inside which all pre-tokens and
merges lie. A longer unit is cut further wherever letters or digits end: whatever stands around, a pre-token ends there. The units' characters and token counts are the leaves of a segment tree. An edit touches the
units it overlaps and one neighbour on either side, beyond which no cut can move: only that region is
encoded again, and only the sums above its leaves change. The region's units go back into its leaves; when a leaf
has come to hold too many of them, the tree is laid out anew, without encoding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.bpe import Transducer, transducer, units
from kinweave.llm.encoding import tokenizer_path
from kinweave.llm.words import slices

#: Characters from which a leaf of several units is split up, and above which a unit is cut further.
CROWDED, WIDE = 1024, 64
#: What stands before a run of letters or digits, and that run.
FINE = regex.compile(r"\s*[^\s\p{L}\p{N}]*(?:\p{L}+|\p{N}+)|\s*[^\s\p{L}\p{N}]+|\s+")
EDITS = "array<struct<at:int,removed:int,inserted:string>>"


def cut(coder: Transducer, text: str) -> list[str]:
    """The units of a text. Special tokens are units of their own."""
    out: list[str] = []
    for segment, special in coder.segments(text):
        if special is not None:
            out.append(segment)
            continue
        for unit in units(segment):
            if len(unit) > WIDE:
                out += FINE.findall(unit)
            elif unit:
                out.append(unit)
    return out


def learn(coder: Transducer, parts: list[list[str]]) -> None:
    """Encodes the new units among all ``parts`` at once."""
    coder.learn(set().union(*parts).difference(coder.table.special))


def counts(coder: Transducer, parts: list[str]) -> list[int]:
    """Tokens of each unit; the units must have been learned, but for long ones."""
    young, special = coder.young, coder.table.special
    return [len(young[u]) // 4 if u in young else (1 if u in special else sum(map(len, coder.direct(u))) // 4) for u in parts]


class Tree:
    """A segment tree over slots, each with the text, characters and tokens of one or more units.

    ``chars[1]`` and ``tokens[1]`` are the totals; slot i is at ``size + i``. ``several`` has the units of the slots that
    hold more than one. An edit deals its region's units to the slots that it touches.
    """

    def __init__(self, texts: list[str], n_tokens: list[int]):
        self._lay(texts, n_tokens)

    def _lay(self, texts: list[str], n_tokens: list[int]) -> None:
        self.texts, self.several = texts or [""], {}
        self.size = 1 << (len(self.texts) - 1).bit_length()
        self.chars, self.tokens = self._summed(list(map(len, self.texts))), self._summed(n_tokens or [0])

    def _summed(self, values: list[int]) -> list[int]:
        sums = np.zeros(2 * self.size, np.int64)
        sums[self.size : self.size + len(values)] = values
        half = self.size
        while half > 1:
            sums[half // 2 : half] = sums[half : 2 * half].reshape(-1, 2).sum(1)
            half //= 2
        return sums.tolist()

    def slot(self, at: int) -> tuple[int, int]:
        """The slot of the character at ``at`` (the last that has any, at the end), and the characters before it."""
        at, node, before = min(at, self.chars[1] - 1), 1, 0
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def put(self, slot: int, text: str, n_tokens: int) -> None:
        self.texts[slot] = text
        node = self.size + slot
        more_chars, more_tokens = len(text) - self.chars[node], n_tokens - self.tokens[node]
        while node and (more_chars or more_tokens):
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def region(self, at: int, removed: int, inserted: str, reach: int) -> tuple[int, int, str]:
        """First and last slot whose tokens an edit can change, and their text after it.

        ``removed`` characters from ``at`` are replaced by ``inserted``; places beyond the text are moved to its
        end. Besides the slots that it overlaps the region has one on each side of them, and all within
        ``reach`` characters, so that a special token that forms or breaks lies inside.
        """
        length = self.chars[1]
        at = max(0, min(at, length))
        end = max(at, min(at + removed, length))
        low = high = before = 0
        if length:
            low, before = self.slot(max(0, at - reach - 1))
            if before:
                low, before = self.slot(before - 1)
            high, start = self.slot(min(length - 1, end + reach))
            after = start + self.chars[self.size + high]
            if after < length:
                high, _ = self.slot(after)
        text = "".join(self.texts[low : high + 1])
        return low, high, text[: at - before] + inserted + text[end - before :]

    def refill(self, low: int, high: int, parts: list[str], n_tokens: list[int]) -> None:
        """Deals units to the slots from ``low`` to ``high``; a crowded slot makes the tree be laid out anew, a unit a slot."""
        n, crowded = high - low + 1, False
        for k in range(n):
            a, b = k * len(parts) // n, (k + 1) * len(parts) // n
            text = "".join(parts[a:b])
            if text or self.chars[self.size + low + k]:
                self.put(low + k, text, sum(n_tokens[a:b]))
            self.several.pop(low + k, None)
            if b - a > 1:
                self.several[low + k] = (parts[a:b], n_tokens[a:b])
                crowded |= len(text) > CROWDED
        if crowded:
            own = [self.several.get(i) or ([t], [self.tokens[self.size + i]]) for i, t in enumerate(self.texts) if t]
            self._lay([u for x, _ in own for u in x], [c for _, y in own for c in y])


def edit_all(coder: Transducer, trees: list[Tree], edits: list) -> list[int]:
    """Applies one edit (at, removed, inserted), or None, to each tree; characters that were encoded again, by tree.

    The regions of all trees are encoded together.
    """
    reach = max([0, *map(len, coder.table.special)])
    regions = [None if e is None else t.region(*e, reach) for t, e in zip(trees, edits, strict=True)]
    parts = [[] if r is None else cut(coder, r[2]) for r in regions]
    learn(coder, parts)
    for tree, r, own in zip(trees, regions, parts, strict=True):
        if r is not None:
            tree.refill(r[0], r[1], own, counts(coder, own))
    return [0 if r is None else len(r[2]) for r in regions]


def recount(docs: DataFrame, path: str, edits: str = "edits") -> DataFrame:
    """Counts tokens of every row of ``docs(doc_id, text, edits)`` before and after its edits, in order.

    ``edits`` is an array of (at, removed, inserted): characters from ``at`` are replaced. Returns doc_id,
    n_tokens, n_tokens_after, n_units, n_chars_after and n_reencoded (characters encoded again). Null texts
    are empty; null edits are none; a null insertion is empty.
    """

    def run(batches):
        coder = transducer(path)
        for batch in slices(batches, 2 << 20):
            texts = batch.column("text").to_pylist()
            edits = [[(e["at"] or 0, e["removed"] or 0, e["inserted"] or "") for e in own or [] if e] for own in batch.column("edits").to_pylist()]
            parts = [cut(coder, t) for t in texts]
            learn(coder, parts)
            trees = [Tree(p, counts(coder, p)) for p in parts]
            first = [(t.tokens[1], len(p)) for t, p in zip(trees, parts, strict=True)]
            again = np.zeros(len(trees), np.int64)
            for k in range(max(map(len, edits), default=0)):
                again += edit_all(coder, trees, [e[k] if k < len(e) else None for e in edits])
            out = [(n, t.tokens[1], u, t.chars[1], a) for (n, u), t, a in zip(first, trees, again.tolist(), strict=True)]
            columns = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.record_batch(
                [batch.column("doc_id"), *map(pa.array, columns)],
                names=["doc_id", "n_tokens", "n_tokens_after", "n_units", "n_chars_after", "n_reencoded"],
            )

    schema = "doc_id long, n_tokens long, n_tokens_after long, n_units long, n_chars_after long, n_reencoded long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(edits).cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, schema)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Gathers ``edits(doc_id, edit_no, at, removed, inserted)`` of each document, in order, beside its text."""
    own = edits.groupBy(F.col("doc_id").alias("edited_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("edit_no", "at", "removed", "inserted"))),
            lambda e: F.struct(e["at"].alias("at"), e["removed"].alias("removed"), e["inserted"].alias("inserted")),
        ).alias("edits")
    )
    return docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("edited_id"), "left").drop("edited_id")


def sample_edits():
    """Four edits that depend on doc_id and length alone: a replacement, an insertion, a deletion and an appendix."""
    n = F.coalesce(F.length("text"), F.lit(0))
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), n + 1).cast("int")
    edit = lambda where, removed, inserted: F.struct(where.alias("at"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))
    return F.array(
        edit(at(1), 7, "changed"), edit(at(2), 0, " a new sentence, with 3 numbers. "), edit(at(3), 40, ""), edit(n + 1000, 0, "\nThe end.")
    )


def op1_edit_aware_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return recount(docs.withColumn("edits", sample_edits()), tokenizer_path("byte_bpe_50k.json"))
