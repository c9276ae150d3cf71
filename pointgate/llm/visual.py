"""One form for texts that look the same, by vocabulary tries and a weighted edit automaton.

The vocabulary holds the spellings of the whole corpus that are clean: no invisible characters, no
wide or decomposed forms, letters of one script.  Spellings walk the tries of the vocabulary as they
stand: a step over an equal or look-alike letter costs nothing, nor does an invisible character or
an accent written apart; any other edit costs ``1``.  A letter may look like several (the palochka like
I and l): the trie tells which of them makes a word.  Of the spellings reached within ``budget`` (0 for
visual identity) the cheapest, then the plainest, then the most frequent becomes canonical.  Tokens
that reach nothing are written by the table of ``lookalikes``.

Spellings that may look the same have an equal ``coarse`` form.  Where only one has it, there is
nothing to choose; the others are cut into tries by its hash, each of a bounded number of words.
Without a budget a walk needs the trie of its own hash only, with one it visits all of them.

The corpus is read twice: for the vocabulary, and to write the forms.  Spellings that differ from
what the table writes are few (spoofed words of other scripts, homographs); they are broadcast up to
``broadcast_spellings``, and joined to the documents beyond.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointgate.llm.lookalikes import coarse, ignorable, looks, shape, skeleton
from pointgate.operators.joins import salted_join
from pointgate.session import cut


def _tokens():  # noqa: ANN202
    import regex

    return regex.compile("[\\p{L}\\p{N}\\p{M}\\p{Cf}\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f]+")


def _odd():  # noqa: ANN202
    import regex

    return regex.compile("[^\\x09\\x0a\\x0d\\x20-\\x7e]")


def _clean():  # noqa: ANN202
    import regex

    scripts = "|".join(rf"[\p{{{s}}}\p{{Common}}\p{{Inherited}}]+" for s in ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana", "Hangul"))
    mixed = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Common}\p{Inherited}]+"
    return regex.compile(f"(?:{scripts}|{mixed})")


@lru_cache(1 << 16)
def clean(token: str) -> bool:
    """Whether a spelling may stand in the vocabulary."""
    if token.isascii():
        return skeleton(token) == token
    return (
        bool(_one_script().fullmatch(token))
        and unicodedata.is_normalized("NFC", token)
        and not any(ignorable(c) or unicodedata.normalize("NFKC", c) != c or (shape(c) != c and (len(shape(c)) != 1 or c.isascii())) for c in token)
    )


@lru_cache(1)
def _one_script():  # noqa: ANN202
    return _clean()


@lru_cache(1 << 16)
def plain_form(token: str) -> str:
    """How a token is written that has no spelling of its own: a clean one stays, others by the table."""
    return token if clean(token) else skeleton(token)


def units(word: str) -> list[tuple[str, ...]]:
    """What a word shows, one unit after the other, with all that each may look like; an invisible character shows ('',)."""
    out: list[tuple[str, ...]] = []
    base = -1
    for ch in unicodedata.normalize("NFD", word):
        mark = unicodedata.combining(ch) or "\u1160" <= ch <= "\u11ff"
        if ignorable(ch):
            out.append(("",))
        elif mark and base >= 0:
            out[base] = tuple(x + ch for x in out[base])
        else:
            base = len(out)
            out.append(looks(ch))
    return [tuple(unicodedata.normalize("NFC", x) for x in u) for u in out]


class _Node:
    __slots__ = ("edges", "like", "word")

    def __init__(self) -> None:
        self.edges: dict[str, _Node] = {}
        #: Nodes behind the edges that may look like a letter.
        self.like: dict[str, list[_Node]] = {}
        self.word: tuple[str, int] | None = None


class Trie:
    """Spellings with their counts, letter by letter as they are written."""

    def __init__(self) -> None:
        self.root = _Node()

    def add(self, word: str, count: int) -> None:
        node = self.root
        for ch in word:
            child = node.edges.get(ch)
            if child is None:
                child = node.edges[ch] = _Node()
                for unit in units(ch)[:1]:
                    for look in unit:
                        node.like.setdefault(look, []).append(child)
            node = child
        node.word = (word, count)

    def walk(self, word: str, budget: float = 0.0) -> list[tuple[float, str, int]]:
        """(cost, spelling, count) of every spelling within the budget."""
        shown = units(word)
        found: dict[str, tuple[float, int]] = {}
        # A state is a node, a place in the word, and letters of the unit there still to come (of a ligature).
        stack = [(self.root, 0, "", 0.0)]
        seen: dict[tuple[int, int, str], float] = {}
        while stack:
            node, i, rest, cost = stack.pop()
            state = (id(node), i, rest)
            if seen.get(state, budget + 1) <= cost:
                continue
            seen[state] = cost
            if rest:
                stack += [(child, i, rest[1:], cost) for child in node.like.get(rest[0], ())]
                continue
            if i == len(shown) and node.word:
                spelling, count = node.word
                if cost <= found.get(spelling, (budget + 1, 0))[0]:
                    found[spelling] = (cost, count)
            if i < len(shown):
                for look in shown[i]:
                    if not look:
                        stack.append((node, i + 1, "", cost))
                    elif look in node.like:
                        stack += [(child, i + 1, "", cost) for child in node.like[look]]
                    elif len(look) > 1:
                        stack.append((node, i + 1, look, cost))
            if cost + 1 <= budget:
                if i < len(shown):
                    stack.append((node, i + 1, "", cost + 1))
                for child in node.edges.values():
                    stack.append((child, i, "", cost + 1))
                    if i < len(shown):
                        stack.append((child, i + 1, "", cost + 1))
        return [(cost, spelling, count) for spelling, (cost, count) in found.items()]


def _rank(found: tuple[float, str, int]) -> tuple:
    cost, spelling, count = found
    return cost, skeleton(spelling) != spelling, -count, spelling


def canonical(word: str, trie: Trie, budget: float = 0.0) -> str:
    """The canonical spelling: cheapest, then one that the table leaves as it is, then the most frequent."""
    found = trie.walk(word, budget)
    return min(found, key=_rank)[1] if found else skeleton(word)


def spellings(texts: DataFrame, *, flush: int = 200_000) -> DataFrame:
    """(token, look, n) of every spelling of the column ``_text`` with its coarse form; counted in the tasks first."""

    def rows(n: Counter[str]) -> pd.DataFrame:
        return pd.DataFrame([(t, coarse(t), k) for t, k in n.items()], columns=["token", "look", "n"])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = _tokens().findall
        n: Counter[str] = Counter()
        for frame in frames:
            for text in frame["_text"]:
                n.update(find(text))
                if len(n) > flush:
                    yield rows(n)
                    n.clear()
        yield rows(n)

    return texts.mapInPandas(count, "token string, look string, n long").groupBy("token", "look").agg(F.sum("n").alias("n"))


def canonical_spellings(texts: DataFrame, *, budget: float = 0.0, trie_words: int = 100_000) -> DataFrame:
    """(token, spelling) of the tokens whose canonical spelling isn't their ``plain_form``."""
    all_ = spellings(texts)
    if budget == 0:
        all_ = all_.withColumn("_k", F.count("*").over(Window.partitionBy("look"))).where("_k > 1").drop("_k")
    walked = cut(all_)
    tries = max(1, -(-walked.count() // trie_words))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        trie, known = Trie(), set()
        for token, n in rows.loc[rows["n"] > 0, ["token", "n"]].itertuples(index=False):
            if clean(token):
                trie.add(token, n)
                known.add(token)
        out = []
        for token in rows["token"].unique():
            found = trie.walk(token, budget)
            if found:
                out.append((token, *min(found, key=_rank)))
        return pd.DataFrame(out, columns=["token", "cost", "spelling", "n"])

    shard = walked.withColumn("_trie", F.pmod(F.xxhash64("look"), F.lit(tries)))
    if budget > 0 and tries > 1:
        # A spelling near a word may stand in any trie: it visits the others too, uncounted.
        others = walked.withColumn("_trie", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tries - 1).cast("long"))))
        shard = shard.union(others.withColumn("n", F.lit(0).cast("long")))
    got = shard.groupBy("_trie").applyInPandas(match, "token string, cost double, spelling string, n long")
    if budget > 0:
        got = got.groupBy("token").agg(F.collect_list(F.struct("cost", "spelling", "n")).alias("_found"))

    def differ(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if budget > 0:
                best = [min(((x["cost"], x["spelling"], x["n"]) for x in found), key=_rank)[1] for found in frame["_found"]]
                frame = pd.DataFrame({"token": frame["token"], "spelling": best})
            yield frame.loc[[s != plain_form(t) for t, s in zip(frame["token"], frame["spelling"])], ["token", "spelling"]]

    return got.mapInPandas(differ, "token string, spelling string")


def _written(text: str, known: dict[str, str]) -> str:
    """The form of a text, with the spellings of ``known``."""
    out, at = [], 0
    for m in _find_tokens().finditer(text):
        token = m.group()
        out.append(skeleton(text[at : m.start()]))
        out.append(skeleton(token) if token.isascii() else known.get(token) or plain_form(token))
        at = m.end()
    out.append(skeleton(text[at:]))
    return unicodedata.normalize("NFC", "".join(out))


@lru_cache(1)
def _find_tokens():  # noqa: ANN202
    return _tokens()


def visual_forms(documents: DataFrame, *, document: str, text: str = "text", budget: float = 0.0, broadcast_spellings: int = 200_000) -> DataFrame:
    """(document, _text, form): the texts in one form; equal forms look the same.

    A null text has no row here; an empty text has the empty form.  What no token covers (blanks,
    punctuation) is written by the table; line breaks, the number of blanks, letter case, accents
    and digits stay.  Tokens of plain ASCII stay too.  Rows with one document id may hold several texts.
    """
    source = documents.where(F.col(document).isNotNull() & F.col(text).isNotNull()).select(F.col(document).alias("_id"), F.col(text).cast("string").alias("_text"))
    named = cut(canonical_spellings(source, budget=budget))
    kind = dict(documents.dtypes)[document]
    schema = f"_id {kind}, _text string, form string"
    if named.count() <= broadcast_spellings:
        spelled = documents.sparkSession.sparkContext.broadcast({r["token"]: r["spelling"] for r in named.toLocalIterator()})

        def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, odd = spelled.value, _odd().search
            for f in frames:
                yield f[["_id", "_text"]].assign(form=[_written(x, known) if odd(x) else skeleton(x) for x in f["_text"]])

        return source.mapInPandas(write, schema).withColumnRenamed("_id", document)

    def needed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, odd = _tokens().findall, _odd().search
        for frame in frames:
            out = [(i, t) for i, x in zip(frame["_id"], frame["_text"]) if odd(x) for t in sorted(set(find(x))) if not t.isascii()]
            yield pd.DataFrame(out, columns=["_id", "token"])

    asked = source.mapInPandas(needed, f"_id {kind}, token string")
    got = asked.join(named, "token").groupBy("_id").agg(F.map_from_entries(F.collect_set(F.struct("token", "spelling"))).alias("_spelled"))

    def write_own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odd = _odd().search
        for f in frames:
            yield f[["_id", "_text"]].assign(form=[_written(x, dict(k) if k is not None else {}) if odd(x) else skeleton(x) for x, k in zip(f["_text"], f["_spelled"])])

    return source.join(got, "_id", "left").mapInPandas(write_own, schema).withColumnRenamed("_id", document)


def visual_pairs(documents: DataFrame, *, document: str, text: str = "text") -> DataFrame:
    """(``document``_a, ``document``_b), smaller first: equal forms, different characters.

    Texts that show nothing are left out.  Copies of one text are one class until the end, so only
    forms with several texts are joined; a form with very many documents is spread over tasks.
    """
    forms = visual_forms(documents, document=document, text=text)
    shown = F.regexp_replace("form", r"[\s\u0085\u2028\u2029]+", "") != ""
    keyed = cut(forms.where(shown).select(F.col(document).alias("_id"), F.md5(F.col("form").cast("binary")).alias("_form"), F.md5(F.col("_text").cast("binary")).alias("_raw")).distinct())
    several = keyed.groupBy("_form").agg(F.count_distinct("_raw").alias("_k")).where("_k > 1").select("_form")
    held = cut(keyed.join(several, "_form", "left_semi"))
    other = held.select("_form", F.col("_id").alias("_other"), F.col("_raw").alias("_other_raw"))
    pairs = salted_join(held, other, ["_form"], ["_id"], hot_rows=100_000).where((F.col("_id") < F.col("_other")) & (F.col("_raw") != F.col("_other_raw")))
    return pairs.select(F.col("_id").alias(f"{document}_a"), F.col("_other").alias(f"{document}_b"))
