"""Passages of evaluation items in a training corpus, found by spaced seeds.

A seed is the hash of the words at the cared-for positions of a fixed mask; the other positions are
ignored.  The hash is that of the words kept, wherever they stood, so a seed of an item and one of a
document meet by any two masks: the same mask on both sides tolerates a changed word, a mask with a
gap against one without tolerates a word added (or left out).  Seeds of both sides are hash-joined,
and the pairs (document, item) that meet are verified: runs of equal words are chained over single
changed or added words into stretches, and one or two stretches in the item's order must hold the
required share of its words.

Places of an item where a document has a seed are counted for each pair.  A document that holds the
required share with edits at least two words apart has seeds at ``needed_starts`` or more places; pairs
with fewer are not verified.

The corpus is read once.  Where the items have at most ``broadcast_seeds`` seeds, their table is
broadcast, and documents are joined, counted and verified where they are read, without a shuffle.
Beyond that the keys of the documents are shuffled to those of the items; a filter (a bit for each
hash, at most ``2**filter_bits`` bits whatever the number of items) first takes out what no item has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgate.llm.lookalikes import folded_words
from pointgate.operators.joins import salted_join
from pointgate.session import cut

#: Masks of the seeds: 1 = the word counts, 0 = any word.  All keep as many words.
MASKS = ("1111", "11101", "11011", "10111")
WIDTH = 4

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter that one group builds.
_PIECE = 1 << 20


class _Hashes(dict):
    """64-bit hashes of words, filled as words come; emptied by its owner when it grows."""

    def __missing__(self, word: str) -> int:
        self[word] = x = xxhash.xxh3_64_intdigest(word) >> 1
        return x


def hashed(words: list[str], known: _Hashes) -> np.ndarray:
    if len(known) > 2_000_000:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def seeds(words: np.ndarray, mask: str, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of the seeds of one mask; with ``owner`` those that lie in one text only."""
    offsets = [i for i, c in enumerate(mask) if c == "1"]
    last = offsets[-1]
    n = len(words) - last
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, len(offsets), np.uint64)
    for o in offsets:
        h = (h ^ words[o : o + n].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    start = np.arange(n)
    if owner is not None:
        start = np.flatnonzero(owner[:n] == owner[last:])
    return start, (h[start] >> np.uint64(1)).astype(np.int64)


def needed_words(words: int, share: float) -> int:
    return max(1, int(np.ceil(share * words - 1e-9)))


def item_masks(words: int, share: float) -> tuple[str, ...]:
    """The masks of an item: of items so short that each of two stretches may have fewer words than a mask, runs of half the words needed."""
    half = -(-needed_words(words, share) // 2)
    return MASKS if half >= WIDTH else ("1" * half,)


def needed_starts(words: int, share: float) -> int:
    """Places of the item with a seed that a document with the required share has at least.

    A changed word after every second one leaves a seed at every third place, an added one at every
    second, so half of the words needed, less what is lost at the ends of two stretches.
    """
    return max(1, needed_words(words, share) // 2 - 4)


def stretches(item: np.ndarray, text: np.ndarray, gap: int) -> list[tuple[int, int, int, int, int]]:
    """Chains of equal runs: (words, item from, item to, text from, text to).

    Runs of two or more words (of one, if the item has fewer than five) follow each other within
    ``gap`` words on both sides.
    """
    least = 2 if len(item) >= 5 else 1
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    low, high = np.searchsorted(ordered, item, "left"), np.searchsorted(ordered, item, "right")
    n = high - low
    i = np.repeat(np.arange(len(item)), n)
    j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    # Equal words on one diagonal, one after the other, are a run.
    width = len(item) + 1
    code = np.sort((j - i) * width + i)
    first = np.flatnonzero(np.diff(code, prepend=-(1 << 62)) != 1)
    size = np.diff(first, append=len(code))
    first, size = first[size >= least], size[size >= least]
    diagonal, i = np.divmod(code[first], width)
    runs = sorted(zip(i.tolist(), (i + diagonal).tolist(), size.tolist()))
    # Best chains by where they end: place in the item, then place in the text.
    ends: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(len(item) + 1)]
    out = []
    for i, j, n in runs:
        best = (n, i, j)
        for a in range(-1, gap + 1):
            # Runs may touch by one word, as after a word that stands twice.
            row = ends[i - a] if 0 <= i - a <= len(item) else None
            if not row:
                continue
            near = row.items() if len(row) <= gap + 2 else [(k, row[k]) for k in range(j - gap, j + 2) if k in row]
            for k, prior in near:
                b = j - k
                if -1 <= b <= gap:
                    words = prior[0] + n + min(a, b, 0)
                    if words > best[0]:
                        best = (words, prior[1], prior[2])
        if best[0] > ends[i + n].get(j + n, (0,))[0]:
            ends[i + n][j + n] = best
        out.append((best[0], best[1], i + n, best[2], j + n))
    return out


def held_share(item: np.ndarray, text: np.ndarray, gap: int = 3) -> float:
    """The largest share of the item's words in one stretch, or in two that keep the item's order.

    Where a foreign sentence parts a passage, its first or last words may be the item's next ones
    by chance; two stretches may therefore overlap by ``gap`` words, which count once.
    """
    chains = stretches(item, text, gap)
    if not chains:
        return 0.0
    c = np.array(sorted(chains, reverse=True))
    best = int(c[0, 0])
    for first in c:
        if 2 * first[0] <= best:
            break
        for before, after in (((first[2], first[4]), (c[:, 1], c[:, 3])), ((c[:, 2], c[:, 4]), (first[1], first[3]))):
            over = np.maximum(np.maximum(before[0] - after[0], before[1] - after[1]), 0)
            apart = over <= gap
            if apart.any():
                best = max(best, int(first[0] + (c[apart, 0] - over[apart]).max()))
    return best / len(item)


def bigrams(words: np.ndarray) -> np.ndarray:
    """A hash of each word with the next."""
    return words[:-1] * np.int64(0x9E3779B97F4A7C1) + words[1:]


def may_hold(item: np.ndarray, item_sorted: np.ndarray, text: np.ndarray, text_sorted: np.ndarray, need: int, gap: int = 3) -> bool:
    """Whether a text can hold ``need`` words of an item in one or two stretches; both are given as bigrams.

    Stretches consist of runs of two or more words (of items of five words or more), so each held
    word stands beside a neighbour that it has in the other text too.  There must be enough such
    words of the item, and in the text half of them near each other: the larger stretch has that
    many, with no more than ``gap`` words between two runs.
    """
    if _beside(item, text_sorted).sum() < need:
        return False
    half = -(-need // 2)
    span = half + gap * half // 2 + 1
    held = np.cumsum(_beside(text, item_sorted))
    most = held[-1] if len(held) <= span else max(held[span - 1], (held[span:] - held[:-span]).max())
    return int(most) >= half


def _beside(words: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of bigrams: which of the words belong to one that the sorted ``other`` has too."""
    met = np.zeros(len(words) + 2, bool)
    if len(other):
        at = np.searchsorted(other, words)
        met[1:-1] = other[np.minimum(at, len(other) - 1)] == words
    return met[1:] | met[:-1]


class Verifier:
    """``held_share`` of pairs, with what belongs to a document or an item computed once while it repeats."""

    def __init__(self, share: float):
        self.share, self.text, self.pairs, self.ordered = share, None, None, None
        self.items: dict = {}

    def holds(self, key: object, item: np.ndarray, text: np.ndarray) -> float | None:
        """The share of the item's words that the text holds if it is large enough; ``key`` names the item."""
        if len(item) >= 5:
            if text is not self.text:
                self.text, self.pairs = text, bigrams(text)
                self.ordered = np.sort(self.pairs)
            if key not in self.items:
                if len(self.items) > 100_000:
                    self.items.clear()
                pairs = bigrams(item)
                self.items[key] = pairs, np.sort(pairs), needed_words(len(item), self.share)
            pairs, ordered, need = self.items[key]
            if not may_hold(pairs, ordered, self.pairs, self.ordered, need):
                return None
        found = held_share(item, text)
        return found if found >= self.share - 1e-9 else None


def _item_words(items: DataFrame, kind: str) -> DataFrame:
    """(_item, words, _iv): distinct items with at least one word, and the hash of their words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for f in frames:
            yield pd.DataFrame({"_item": f["_item"], "words": pd.Series([hashed(folded_words(t), known) for t in f["_text"]], dtype=object)})

    rows = items.mapInPandas(run, f"_item {kind}, words array<long>").where(F.size("words") > 0)
    return rows.withColumn("_iv", F.xxhash64("words")).dropDuplicates(["_item", "_iv"])


def _item_seeds(items: DataFrame, kind: str, share: float) -> DataFrame:
    """(key, _item, _iv, start, least) of the seeds of each item; ``least`` places must be met."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = [pd.DataFrame(columns=["key", "start", "_item", "_iv", "least"])]
            for name, words, version in f[["_item", "words", "_iv"]].itertuples(index=False):
                for mask in item_masks(len(words), share):
                    start, key = seeds(np.asarray(words, np.int64), mask)
                    parts.append(pd.DataFrame({"key": key, "start": start, "_item": name, "_iv": version, "least": needed_starts(len(words), share)}))
            yield pd.concat(parts[1:] or parts)

    return items.mapInPandas(run, f"key long, start int, _item {kind}, _iv long, least int")


class Table:
    """The seeds and words of all items, sorted for the join where the documents are read."""

    def __init__(self, items: pd.DataFrame, rows: pd.DataFrame):
        self.items = items["_item"].tolist()
        self.words = [np.asarray(w, np.int64) for w in items["words"]]
        number = {k: i for i, k in enumerate(zip(self.items, items["_iv"]))}
        item = np.array([number[k] for k in zip(rows["_item"], rows["_iv"])], np.int64)
        self.least = np.ones(len(self.items), np.int64)
        self.least[item] = rows["least"]
        order = np.argsort(rows["key"].to_numpy(np.int64), kind="stable")
        self.keys, self.begin, self.count = np.unique(rows["key"].to_numpy(np.int64)[order], return_index=True, return_counts=True)
        #: Item and start of each seed in one number.
        self.width = int(rows["start"].max()) + 1 if len(rows) else 1
        self.place = (item * self.width + rows["start"].to_numpy(np.int64))[order] if len(rows) else np.zeros(0, np.int64)
        # Most seeds of a corpus are of no item: one look at a table of bits tells.
        self.bits = max(16, int(len(self.keys) * 16).bit_length())
        self.have = np.zeros(1 << self.bits, bool)
        self.have[self.keys & ((1 << self.bits) - 1)] = True

    def pairs(self, words: np.ndarray, owner: np.ndarray, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) that meet at as many places as the item wants."""
        docs, places = [], []
        for mask in masks:
            start, key = seeds(words, mask, owner)
            some = self.have[key & ((1 << self.bits) - 1)]
            start, key = start[some], key[some]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            some = self.keys[at] == key if len(key) else np.zeros(0, bool)
            start, at = start[some], at[some]
            n = self.count[at]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[at], n)
            docs.append(np.repeat(owner[start], n))
            places.append(self.place[entry])
        doc, place = np.concatenate(docs), np.concatenate(places)
        whole = len(self.items) * self.width
        # Every document of the batch with all items is one range of numbers: places sort by pair.
        code = np.sort(doc * whole + place)
        code = code[np.diff(code, prepend=-1) != 0]
        pair = code // self.width
        first = np.flatnonzero(np.diff(pair, prepend=-1) != 0)
        pair, n = pair[first], np.diff(first, append=len(pair))
        doc, item = np.divmod(pair, max(len(self.items), 1))
        enough = n >= self.least[item]
        return doc[enough], item[enough]


def _batches(frames: Iterator[pd.DataFrame], batch_words: int) -> Iterator[tuple[list, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(ids, words of each document, words, document of each word) of about ``batch_words`` words."""
    known = _Hashes()
    for frame in frames:
        names, held, size = [], [], 0
        for k, (name, text) in enumerate(zip(frame["_document"], frame["_text"]), 1):
            names.append(name)
            held.append(hashed(folded_words(text), known))
            size += len(held[-1])
            if size >= batch_words or k == len(frame):
                yield names, held, np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
                names, held, size = [], [], 0


def _joined_at_reading(documents: DataFrame, kinds: tuple[str, str], table, masks: tuple[str, ...], share: float, batch_words: int) -> DataFrame:  # noqa: ANN001
    """(_document, _item, share) by a broadcast ``Table``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, verifier = table.value, Verifier(share)
        for names, held, words, owner in _batches(frames, batch_words):
            out = []
            for d, i in zip(*(x.tolist() for x in items.pairs(words, owner, masks))):
                if (found := verifier.holds(i, items.words[i], held[d])) is not None:
                    out.append((names[d], items.items[i], found))
            yield pd.DataFrame(out, columns=["_document", "_item", "share"])

    return documents.mapInPandas(run, f"_document {kinds[0]}, _item {kinds[1]}, share double")


def _filter_bits(keys: DataFrame, n: int, filter_bits: int) -> np.ndarray:
    """The filter: bit ``key % size`` is set for every key; its size follows the keys up to the bound."""
    bits = min(filter_bits, max(20, int(n * 16).bit_length()))
    out = np.zeros((1 << bits) // 8, np.uint8)

    def piece(rows: pd.DataFrame) -> pd.DataFrame:
        here = np.zeros(_PIECE, np.uint8)
        here[(rows["bit"].to_numpy() % _PIECE)] = 1
        return pd.DataFrame({"piece": [int(rows["bit"].iloc[0]) // _PIECE], "bits": [np.packbits(here, bitorder="little").tobytes()]})

    at = keys.select(F.pmod("key", F.lit(1 << bits)).alias("bit")).distinct()
    for row in at.groupBy(F.call_function("div", "bit", F.lit(_PIECE))).applyInPandas(piece, "piece long, bits binary").toLocalIterator():
        out[row["piece"] * _PIECE // 8 : (row["piece"] + 1) * _PIECE // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _joined_by_shuffle(documents: DataFrame, kinds: tuple[str, str], items: DataFrame, keys: DataFrame, bits, masks: tuple[str, ...], share: float, batch_words: int) -> DataFrame:  # noqa: ANN001
    """(_document, _item, share) by a shuffled join of the keys that pass the filter."""

    def passed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = bits.value
        for names, held, words, owner in _batches(frames, batch_words):
            docs, keys_ = [], []
            for mask in masks:
                start, key = seeds(words, mask, owner)
                at = key & (len(have) * 8 - 1)
                some = (have[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                docs.append(owner[start[some]])
                keys_.append(key[some])
            doc, key = np.concatenate(docs), np.concatenate(keys_)
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            fresh = (np.diff(doc, prepend=-1) != 0) | (np.diff(key, prepend=-1) != 0)
            doc, key = doc[fresh], key[fresh]
            first = np.flatnonzero(np.diff(doc, prepend=-1) != 0)
            which = doc[first]
            each = np.split(key, first[1:]) if len(first) else []
            yield pd.DataFrame({"_document": [names[d] for d in which], "words": pd.Series([held[d] for d in which], dtype=object), "keys": pd.Series(each, dtype=object)})

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        verifier = Verifier(share)
        for f in frames:
            found = [verifier.holds((k, v), np.asarray(i, np.int64), np.asarray(d, np.int64)) for k, v, i, d in zip(f["_item"], f["_iv"], f["item_words"], f["words"])]
            f = f[["_document", "_item"]].assign(share=pd.Series(found, dtype=float, index=f.index))
            yield f[f["share"].notna()]

    found = documents.mapInPandas(passed, f"_document {kinds[0]}, words array<long>, keys array<long>")
    found = cut(found.withColumn("_dv", F.xxhash64("words")).dropDuplicates(["_document", "_dv"]))
    asked = found.select("_document", "_dv", F.explode("keys").alias("key"))
    met = salted_join(asked, keys, ["key"], ["_document"]).select("_document", "_dv", "_item", "_iv", "least", "start").distinct()
    pairs = cut(met.groupBy("_document", "_dv", "_item", "_iv", "least").agg(F.count("*").alias("_n")).where(F.col("_n") >= F.col("least")))
    pairs = salted_join(pairs, items.withColumnRenamed("words", "item_words"), ["_item", "_iv"], ["_document", "_dv"])
    pairs = pairs.join(found.drop("keys"), ["_document", "_dv"]).select("_document", "_item", "_iv", "words", "item_words")
    return pairs.mapInPandas(verified, f"_document {kinds[0]}, _item {kinds[1]}, share double")


def leaks(
    documents: DataFrame, items: DataFrame, *, document: str, item: str, text: str = "text", item_text: str = "text", share: float = 0.4,
    broadcast_seeds: int = 8_000_000, filter_bits: int = 30, batch_words: int = 400_000,
) -> DataFrame:
    """(document, item, share) of every document that holds ``share`` of an item's words.

    Letter case, punctuation, layout, accents and look-alike characters don't count, nor do single
    changed or added words.  Null ids, null texts and wordless texts hold nothing and are held by
    nothing.  Rows with one document id and item id give one row, with the largest share; empty
    tables give an empty result.  Where both ids have one name, the item's becomes ``item_``name.
    """
    kinds = dict(documents.dtypes)[document], dict(items.dtypes)[item]
    context = documents.sparkSession.sparkContext
    held = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).alias("_item"), F.col(item_text).alias("_text"))
    held = cut(_item_words(held, kinds[1]))
    keys = cut(_item_seeds(held, kinds[1], share))
    # Runs of one to three words are looked for only where an item is so short that it needs them.
    short = held.agg(*[F.max((_half(F.size("words"), share) == n).cast("int")).alias(f"n{n}") for n in range(1, WIDTH)]).first()
    masks = (*MASKS, *("1" * n for n in range(1, WIDTH) if short[f"n{n}"]))
    source = documents.where(F.col(document).isNotNull() & F.col(text).isNotNull()).select(F.col(document).alias("_document"), F.col(text).alias("_text"))
    n = keys.count()
    if n <= broadcast_seeds:
        table = context.broadcast(Table(held.toPandas(), keys.toPandas()))
        found = _joined_at_reading(source, kinds, table, masks, share, batch_words)
    else:
        bits = context.broadcast(_filter_bits(keys, n, filter_bits))
        found = _joined_by_shuffle(source, kinds, held, keys, bits, masks, share, batch_words)
    name = item if item != document else f"item_{item}"
    return found.groupBy(F.col("_document").alias(document), F.col("_item").alias(name)).agg(F.max("share").alias("share"))


def _half(words: Column, share: float) -> Column:
    """Half of the words needed, as ``item_masks`` takes it."""
    return F.ceil(F.greatest(F.lit(1), F.ceil(words * share - 1e-9)) / 2)
