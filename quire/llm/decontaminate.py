"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted, release_memory, staged

#: Bytes: A-Z lower-cased, all that isn't a word's ([0-9a-z] or beyond ASCII) a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BREAK = b"#"  # between texts; never a word
_CHUNK = 4 << 20  # bytes of text that are taken apart at once


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """Of several sequences; a state stands for the substrings that end at the same places."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state that the arc p-w-> must lead to: q, or a copy of q for its shorter substrings."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for w in sequence:
            if (q := self.next[last].get(w)) is not None:
                last = self._split(last, w, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p != -1:
                self.link[new] = self._split(p, w, self.next[p][w])
            last = new

    def stream(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """At each element, the state and the length of the longest match that ends there."""
        state = length = 0
        for w in sequence:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            yield state, length


class Matcher:
    """Finds the windows of items in texts. A window is `window` consecutive words of an item, or the whole of a shorter item."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {_BREAK: -2}
        taken = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary) - 1) for w in words(text)]) for key, text in items]
        taken = [(key, s) for key, s in taken if s]
        self.automaton = a = SuffixAutomaton()
        for _, s in taken:
            a.add(s)
        #: For each state, the one of the last `window` words of what it spells (0 if it is shorter).
        self.ancestor = self._ancestors()
        self.items: dict[int, set[str]] = {}  # by the state of a window
        short: dict[int, dict[int, set[str]]] = {}  # items below the window, by the state that spells them and their length
        for key, s in taken:
            state = 0
            for state, length in a.stream(s):
                if length >= window:
                    self.items.setdefault(self.ancestor[state], set()).add(key)
            if len(s) < window:
                while a.length[a.link[state]] >= len(s):
                    state = a.link[state]  # fewer than window steps
                short.setdefault(state, {}).setdefault(len(s), set()).add(key)
        self.short = {k: sorted(v.items()) for k, v in short.items()}
        #: For each state, the nearest of its suffixes, itself included, that is a short item's (0 if none is).
        self.nearest = self._nearest() if self.short else []
        #: Words in a row that any window needs, and the pairs of words that occur in items.
        self.least = min((min(window, len(s)) for _, s in taken), default=0)
        self.size = len(self.vocabulary)
        self.pairs = np.unique(np.array([x * self.size + y for _, s in taken for x, y in zip(s, s[1:], strict=False)], np.int64))

    def _by_length(self) -> list[int]:
        """The states behind the first, shorter ones first: a state's suffixes come before it."""
        return sorted(range(1, len(self.automaton.length)), key=self.automaton.length.__getitem__)

    def _ancestors(self) -> list[int]:
        link, length, out = self.automaton.link, self.automaton.length, [0] * len(self.automaton.length)
        for state in self._by_length():
            if length[state] >= self.window:
                out[state] = state if length[link[state]] < self.window else out[link[state]]
        return out

    def _nearest(self) -> list[int]:
        out = [0] * len(self.automaton.length)
        for state in self._by_length():
            out[state] = state if state in self.short else out[self.automaton.link[state]]
        return out

    def _runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches in which a window can lie: every neighbouring pair of words is one of an item."""
        if not self.least or not len(ids):
            return
        known = ids >= 0
        if self.least == 1:
            linked = known
        else:
            linked = known[:-1] & known[1:]
            at = np.flatnonzero(linked)
            key = ids[at].astype(np.int64) * self.size + ids[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            linked[at] = self.pairs[place] == key if len(self.pairs) else False
        edge = np.flatnonzero(np.diff(np.concatenate(([0], linked.view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2] + (self.least > 1)
        for k in np.flatnonzero(ends - starts >= self.least):
            yield int(starts[k]), int(ends[k])

    def find(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its number of words, the stretches of words inside windows (end excluded, merged), the items."""
        flat = (b" " + _BREAK + b" ").join([b"", *[t.translate(_WORD_BYTES) for t in texts], b""]).split()
        ids = np.fromiter(map(self.vocabulary.get, flat, repeat(-1)), np.int32, len(flat))
        breaks = np.flatnonzero(ids == -2)
        found = [(int(b - a - 1), [], set()) for a, b in zip(breaks, breaks[1:], strict=False)]
        link, ancestor, nearest, size = self.automaton.link, self.ancestor, self.nearest, self.automaton.length
        last, known = -1, set()  # windows whose items the text has already
        for start, end in self._runs(ids):
            text = int(np.searchsorted(breaks, start)) - 1
            _, spans, items = found[text]
            if text != last:
                last, known = text, set()
            base = int(breaks[text]) + 1
            for j, (state, length) in enumerate(self.automaton.stream(ids[start:end].tolist()), start - base + 1):
                covered = 0
                if length >= self.window:
                    covered = length
                    if (w := ancestor[state]) not in known:
                        known.add(w)
                        items |= self.items[w]
                if nearest:
                    s = nearest[state]
                    while s > 0:  # fewer than window steps: short items that end here have different lengths
                        for n, keys in self.short[s]:
                            if n <= length:
                                covered = max(covered, n)
                                if (s, n) not in known:
                                    known.add((s, n))
                                    items |= keys
                        s = nearest[link[s]] if size[link[s]] else 0
                if covered:
                    first = j - covered
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, j))
        return found


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these stretches of words and the white space behind each."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, rest = [], 0
    for first, end in spans:
        out.append(text[rest : at[first][0]])
        rest = at[end - 1][1]
        while rest < len(text) and text[rest] in b" \t\r\n":
            rest += 1
    return b"".join([*out, text[rest:]])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and out[-1][1] >= first:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """How many blocks the items are in, and the blocks, each collected when its turn comes."""
    rows = items.select(quoted(id_col).cast("string").alias("key"), F.coalesce(quoted(text_col), F.lit("")).cast("binary").alias("text")).where(F.col("key").isNotNull())
    rows = rows.dropDuplicates()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / (6 * block_words)))
    if n > 1:
        rows = staged(rows, "items")
    block = lambda i: rows.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i).toLocalIterator()
    return n, ([(r.key, bytes(r.text)) for r in block(i)] for i in range(n))


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    keep: tuple[str, ...] = (),
    block_words: int = 200_000,
) -> DataFrame:
    """One row per row of docs: id_col, the columns `keep` (but those called as one of the others), n_words, spans, items.

    Words are runs of characters beyond ASCII, digits and letters, A-Z lower-cased. spans are the stretches of words (start from 0,
    end excluded) that lie inside occurrences of windows of items, merged where they touch; items are the ids, as strings, of the
    items with an occurring window, sorted as strings. A null or empty text has no words; an item without words, or with a null id,
    has no windows; items of the same id count as one. No items, or no rows, are no special case. Texts are taken whole.

    The automaton goes to every task. Items beyond about block_words words are taken in blocks, collected and sent one at a time, so
    that stays bounded however many items there are. For one block there is one pass and no shuffle. For more, docs is written
    once to the shared folder with a number for each row; each block has a pass over the numbers and texts, which gives rows for texts with
    hits only, and these narrow rows are joined to docs in the end.
    """
    made = {id_col.lower(), "n_words", "spans", "items"}
    keep = tuple(c for c in keep if c.lower() not in made)
    found = _find(docs, (id_col, *keep), text_col, items, item_id_col, item_text_col, window, block_words)
    return found.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate((id_col, *keep))], "n_words", "spans", "items")


_SPANS = "array<struct<start:bigint,end:bigint>>"


def _find(docs: DataFrame, keep: tuple[str, ...], text_col: str, items: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 200_000, cut_from: int = 0) -> DataFrame:
    """_keep_0, _keep_1, ... (the columns keep), n_words, spans, items; with cut_from, the text among keep without spans of so many words."""
    text = F.coalesce(quoted(text_col), F.lit("")).cast("binary").alias("_text")
    kept = [quoted(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, text)
    n, blocks = _blocks(items, item_id_col, item_text_col, block_words)
    cut_column = f"_keep_{keep.index(text_col)}" if cut_from else None
    if n == 1:
        return _pass(rows, Matcher(next(blocks), window), cut_column, cut_from)
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    hits = None
    for block in blocks:
        made = _pass(rows.select("_row", "_text"), Matcher(block, window)).where(F.size("spans") > 0)
        made = staged(made.select("_row", "spans", "items"), "hits")
        hits = made if hits is None else hits.unionByName(made)
    merged = hits.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = rows.join(merged, "_row", "left").drop("_row")
    joined = joined.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in (("spans", _SPANS), ("items", "array<string>"))})
    return _pass(joined, None, cut_column, cut_from)


def _pass(rows: DataFrame, matcher: Matcher | None, cut_column: str | None = None, cut_from: int = 0) -> DataFrame:
    """rows with n_words, spans and items instead of _text: found by the matcher, or, without one, put in order from what rows has."""
    shared = rows.sparkSession.sparkContext.broadcast(matcher) if matcher else None
    names = [c for c in rows.columns if c not in ("_text", "spans", "items")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            texts, found = batch.column("_text").to_pylist(), []
            if shared is None:
                old = ([_merged([(x["start"], x["end"]) for x in s]) for s in batch.column("spans").to_pylist()], batch.column("items").to_pylist())
                found = [(len(words(t)), s, i) for t, s, i in zip(texts, *old, strict=True)]
            at = len(found)
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= _CHUNK):
                    size += len(texts[end])
                    end += 1
                found += shared.value.find(texts[at:end])
                at = end
            spans = [f[1] for f in found]
            new = {
                "n_words": pa.array([f[0] for f in found], pa.int64()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], spans_type),
                "items": pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())),
            }
            kept = {c: batch.column(c) for c in names}
            if cut_column:
                long = [[(a, b) for a, b in s if b - a >= cut_from] for s in spans]
                if any(long):
                    old = batch.column(cut_column).to_pylist()
                    kept[cut_column] = pa.array([cut(t.encode(), s).decode() if s else t for t, s in zip(old, long, strict=True)], batch.column(cut_column).type)
            yield pa.RecordBatch.from_pydict(kept | new)

    return rows.mapInArrow(find, f"{schema}, n_words bigint, spans {_SPANS}, items array<string>")


def remove_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", span_limit: int = 10, coverage_limit: float = 0.5, short_items: bool = False, **how) -> DataFrame:
    """docs without what it shares with the items; docs' columns.

    Spans of at least span_limit words go from the text, with the white space behind each; with short_items also the shorter ones that
    are the whole of an item, for which windows mustn't be shorter than span_limit. A document of which more than
    coverage_limit lies in spans goes as a whole: what is left of it is the frame of a test item. Other rows stay as they are,
    those of null or empty texts and repeated ones too; columns may have any names. Long texts, and no rows or items, are as in
    find_contamination.
    """
    if short_items and how.get("window", 10) < span_limit:
        raise ValueError("with short_items a window needs at least span_limit words")
    keep = tuple(docs.columns)
    # a span below span_limit, thus below the window, is made of whole items
    found = _find(docs, keep, text_col, items, cut_from=1 if short_items else span_limit, **how)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    found = found.where((hit <= coverage_limit * F.col("n_words")) | (F.col("n_words") == 0))
    return found.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
