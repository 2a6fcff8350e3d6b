"""Cross-tokenizer alignment: groups of tokens of two vocabularies over the same bytes, and how often ids are linked."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted, staged, worker_memory
from .token_counts import spaces_of, vocabulary_path

_CHUNK = 1 << 20  # characters of text that are aligned at once
_KEPT = 64  # characters up to which a stretch is remembered
_MEMORY = 192 << 20  # bytes, about, of the stretches that a worker remembers
_UNIT = 1 << 14  # characters of stretches that are encoded together
_LARGE = 4096  # links of a group up to which they are made one by one
_PAIRS = 1 << 20  # linked pairs among which a task counts documents
_SPACE = "▁"
#: Cuts that no token of either vocabulary reaches over: single spaces between two characters that aren't white space.
_CUTS = re.compile(r" (?=\S)(?<=\S )").split
Spans = tuple[np.ndarray, np.ndarray]  # ids, and where each token's bytes end


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _refined(ends: np.ndarray, shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where tokens' bytes end: coarse ends, but for shared tokens, which end their bytes (sizes) behind the end of the token before."""
    if not shared.any():
        return ends
    total = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(shared, -1, np.arange(len(ends))))  # the last token before that has an end of its own
    base = np.where(last >= 0, ends[last] - total[last], 0)
    return base + total


class ByteLevelSpans:
    """Tokens of a byte-level vocabulary of the tokenizers library; special tokens' strings inside texts are plain text."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        path = vocabulary_path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.cuts = spaces_of(path) == "leading"
        letters = byte_letters()
        known = {i: bytes(letters[c] for c in token) for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if set(token) <= letters.keys()}
        self.bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[Spans]:
        """Character offsets give the ends; where the next token begins within this one's last character, decoded bytes do."""
        out: list[Spans] = []
        for text, e in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            offsets = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
            ends = offsets[:, 1]
            if not text.isascii():
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                places = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))))
                shared = np.append(offsets[1:, 0] < ends[:-1], False)
                ends = _refined(places[ends], shared, self.sizes[ids])
            out.append((ids, ends))
        return out


class PieceSpans:
    """Tokens of a SentencePiece model that adds a space in front; texts are given without it, and ends count it."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(model_file))
        n, piece = self.processor.get_piece_size(), self.processor.id_to_piece
        of_byte = [self.processor.is_byte(i) for i in range(n)]
        self.of_byte = np.array(of_byte)
        self.bytes = [bytes([int(piece(i)[3:-1], 16)]) if of_byte[i] else piece(i).replace(_SPACE, " ").encode() for i in range(n)]
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.cuts = not any(_SPACE in piece(i)[1:] and piece(i).strip(_SPACE) for i in range(n))

    def encode(self, texts: list[str]) -> list[Spans]:
        """The library's byte spans give the ends; tokens of single bytes share their character's span, so their decoded bytes do."""
        out: list[Spans] = []
        for made in self.processor.encode(texts, return_type="proto"):
            both = np.array([x for p in made.pieces for x in (p.id, p.end)], np.int64)
            ids, ends = both[::2], both[1::2] + 1
            out.append((ids, _refined(ends, self.of_byte[ids], self.sizes[ids])))
        return out


def groups_of(a: Spans, b: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places where tokens of both end, and for the tokens of a and of b the number of the group between these that each is in."""
    cuts = np.intersect1d(a[1], b[1])
    return cuts, np.searchsorted(cuts, a[1]), np.searchsorted(cuts, b[1])


class Stretches:
    """What is known of stretches of text: numbers of tokens, groups and links, the groups as text, and the linked id pairs.

    An entry is a place in these tables. Short stretches are remembered, up to _MEMORY bytes; others stand at the end until `forget`.
    """

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = ByteLevelSpans(a), PieceSpans(b)
        self.cuts = self.a.cuts and self.b.cuts
        self.said_a, self.said_b = (np.array([f"{i}{end}" for i in range(len(x.bytes)) for end in ("," + last)], object) for x, last in ((self.a, "|"), (self.b, ";")))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.numbers = array("q")  # n_a, n_b, n_groups, n_links of each entry
        self.valid = bytearray()
        self.text: list[bytes] = []
        self.first = array("q", [0])  # where the pairs of each entry begin
        self.pairs, self.times = array("q"), array("q")
        self.seen = np.zeros(0, np.int64)  # how often each entry was met
        self.size = 0

    def add(self, words: list[str]) -> None:
        """Entries for stretches, each behind a space. Those that begin and end with a character that isn't white space are joined and
        encoded together, as no token reaches over the space between two of them."""
        plain = [w for w in words if self.cuts and not w[0].isspace() and not w[-1].isspace()]
        at = 0
        while at < len(plain):
            end, size = at, 0
            while end < len(plain) and (end == at or size + len(plain[end]) < _UNIT):
                size += len(plain[end])
                end += 1
            self._add(plain[at:end])
            at = end
        for w in words:
            if w not in self.place:
                self._add([w])

    def _add(self, words: list[str]) -> None:
        text = " ".join(words)
        raw = f" {text}".encode()
        (a,), (b,) = self.a.encode([f" {text}"]), self.b.encode([text])
        same = b"".join(map(self.a.bytes.__getitem__, a[0].tolist())) == raw == b"".join(map(self.b.bytes.__getitem__, b[0].tolist()))
        if not same and len(words) > 1:
            half = len(words) // 2
            self._add(words[:half])
            self._add(words[half:])
            return
        n = len(words)
        if not same:
            self._enter(words, [False], np.zeros((1, 4), np.int64), [b""], np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), len(raw))
            return
        ends = np.cumsum([1 + len(w.encode()) for w in words])  # of each stretch; all are cuts
        cuts, group_a, group_b = groups_of(a, b)
        word = np.searchsorted(ends, cuts)  # of each group
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        links = in_a * in_b
        start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        whole = lambda groups, x: np.bincount(groups, weights=x, minlength=n).astype(np.int64)
        numbers = np.stack([whole(word, in_a), whole(word, in_b), np.bincount(word, minlength=n), whole(word, links)], axis=1)
        # each token with what stands behind it: a comma, or what ends its side of the group
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        said = np.empty(len(a[0]) + len(b[0]), object)
        said[np.arange(len(a[0])) + start_b[group_a]] = self.said_a[2 * a[0] + last_a]
        said[np.arange(len(b[0])) + (start_a + in_a)[group_b]] = self.said_b[2 * b[0] + last_b]
        said, upto = said.tolist(), np.cumsum(numbers[:, 0] + numbers[:, 1]).tolist()
        texts = ["".join(said[i:j])[:-1].encode() for i, j in zip([0, *upto], upto, strict=False)]
        if links.max() <= _LARGE:
            group = np.repeat(np.arange(len(cuts)), links)
            within = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
            pairs = a[0][start_a[group] + within // in_b[group]] << 32 | b[0][start_b[group] + within % in_b[group]]
            times, each = np.ones(len(pairs), np.int64), numbers[:, 3]
        else:  # where neither cuts for long, ids with their numbers instead of all tokens with each other
            found: list[tuple[np.ndarray, np.ndarray]] = []
            each = np.zeros(n, np.int64)
            for g in range(len(cuts)):
                (x, m), (y, k) = (np.unique(i[s : s + c], return_counts=True) for i, s, c in ((a[0], start_a[g], in_a[g]), (b[0], start_b[g], in_b[g])))
                found.append(((x[:, None] << 32 | y[None, :]).ravel(), (m[:, None] * k[None, :]).ravel()))
                each[word[g]] += len(x) * len(y)
            pairs, times = (np.concatenate([f[i] for f in found]) for i in range(2))
        self._enter(words, [True] * n, numbers, texts, each, pairs, times, len(raw))

    def _enter(self, words: list[str], valid: list[bool], numbers: np.ndarray, texts: list[bytes], each: np.ndarray, pairs: np.ndarray, times: np.ndarray, size: int) -> None:
        self.place.update(zip(words, range(len(self.valid), len(self.valid) + len(words)), strict=True))
        self.valid.extend(valid)
        self.text += texts
        self.first.frombytes((len(self.pairs) + np.cumsum(each)).astype(np.int64).tobytes())
        for table, rows in ((self.numbers, numbers), (self.pairs, pairs), (self.times, times)):
            table.frombytes(np.ascontiguousarray(rows, np.int64).tobytes())
        self.size += 300 * len(words) + 2 * size + sum(map(len, texts)) + 16 * len(pairs)

    def forget(self, words: list[str], entries: int) -> None:
        """Takes away the last entries, those of words, down to `entries` of them; once they are too many, those that were met once as well."""
        for w in words:
            del self.place[w]
        del self.valid[entries:], self.text[entries:], self.first[entries + 1 :], self.numbers[4 * entries :]
        del self.pairs[self.first[-1] :], self.times[self.first[-1] :]
        self.seen = self.seen[:entries]
        if self.size <= _MEMORY:
            return
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) * 2 > entries:  # many are met again and again: only those above the median stay
            keep = np.flatnonzero(self.seen > np.median(self.seen))
        first = np.array(self.first, np.int64)
        each = first[keep + 1] - first[keep]
        own = self._pairs_at(keep)
        at = dict(zip(keep.tolist(), range(len(keep)), strict=True))
        ordered = [w for _, w in sorted((at[i], w) for w, i in self.place.items() if i in at)]
        numbers, pairs, times = np.array(self.numbers, np.int64).reshape(-1, 4)[keep], np.array(self.pairs, np.int64)[own], np.array(self.times, np.int64)[own]
        texts, valid = [self.text[k] for k in keep], [self.valid[k] for k in keep]
        self.clear()
        self._enter(ordered, valid, numbers, texts, each, pairs, times, sum(map(len, ordered)))
        self.seen = np.zeros(len(ordered), np.int64)

    def _pairs_at(self, entries: np.ndarray) -> np.ndarray:
        """The places of the pairs of some entries."""
        first = np.frombuffer(self.first, np.int64)
        starts = first[entries]
        sizes = first[entries + 1] - starts
        return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)

    def look_up(self, texts: list[str | None]) -> tuple[list[list[int]], list[str], int]:
        """The entries of each text's stretches, none for one without tokens; with the stretches to forget and the entries to leave."""
        cut = _CUTS if self.cuts else lambda text: [text]
        words = [cut(t) if t else [] for t in texts]
        new = set().union(*words).difference(self.place)
        self.add([w for w in new if len(w) <= _KEPT])
        entries, size = len(self.valid), self.size
        brief = [w for w in new if len(w) > _KEPT]
        self.add(brief)
        found = [list(map(self.place.__getitem__, own)) for own in words]
        odd = [k for k, own in enumerate(found) if not all(map(self.valid.__getitem__, own))]
        if odd:  # only the whole text's bytes decide
            whole = list({texts[k] for k in odd} - self.place.keys())
            self.add(whole)
            brief += whole
            for k in odd:
                entry = self.place[texts[k]]
                found[k] = [entry] if self.valid[entry] else []
        self.size = size  # what goes at once doesn't count
        self.seen = np.concatenate([self.seen, np.zeros(len(self.valid) - len(self.seen), np.int64)])
        self.seen += np.bincount(np.fromiter(chain.from_iterable(found), np.int64), minlength=len(self.seen))
        return found, brief, entries

    def links_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct linked pairs of a text, in order, and how often it links each."""
        at = self._pairs_at(entries)
        pairs, inverse = np.unique(np.frombuffer(self.pairs, np.int64)[at], return_inverse=True)
        return pairs, np.bincount(inverse.ravel(), weights=np.frombuffer(self.times, np.int64)[at], minlength=len(pairs)).astype(np.int64)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch, about _CHUNK characters at a time: where they begin, and they."""
    sizes = [s or 0 for s in batch.column("_size").to_pylist()]
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= _CHUNK):
            size += sizes[end]
            end += 1
        yield at, batch.column("_text").slice(at, end - at).to_pylist()
        at = end


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _survey(rows: DataFrame, a: str, b: str) -> DataFrame:
    """For each row its numbers, groups_sha256, and its distinct linked pairs (each less the one before) with their times; and (code, n), how many rows
    hold each pair, in parts that have to be added."""
    fields = [("_id", None), *[(c, pa.int64()) for c in _NUMBERS], ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("code", pa.int64()), ("n", pa.int64())]
    names = [f[0] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_memory(f"alignment {a} {b}", lambda: Stretches(a, b))
        held: list[np.ndarray] = []
        size = 0

        def made(n: int, id_type: pa.DataType, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t or id_type) for c, t in fields], names)

        def counted(id_type: pa.DataType) -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return made(len(codes), id_type, {"code": pa.array(codes), "n": pa.array(n.astype(np.int64))})

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("_id").type
            for at, texts in _chunks(batch):
                found, brief, entries = known.look_up(texts)
                numbers = np.array(known.numbers, np.int64).reshape(-1, 4)
                sums, digests, links = [], [], []
                for own in found:
                    places = np.array(own, np.int64)
                    sums.append(numbers[places].sum(axis=0))
                    digests.append(hashlib.sha256(b";".join(map(known.text.__getitem__, own))).hexdigest() if own else "")
                    links.append(known.links_of(places))
                known.forget(brief, entries)
                held += [p for p, _ in links]
                size += sum(len(p) for p, _ in links)
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for p, _ in links]))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in ([np.diff(p, prepend=0) for p, _ in links], [t for _, t in links])]
                sums = np.array(sums, np.int64).reshape(-1, 4)
                yield made(len(found), kind, {"_id": batch.column("_id").slice(at, len(found)), **{c: pa.array(np.ascontiguousarray(sums[:, i])) for i, c in enumerate(_NUMBERS)}, "groups_sha256": pa.array(digests, pa.string()), "pairs": lists[0], "times": lists[1]})
                if size > _PAIRS:
                    yield counted(kind)
                    held.clear()
                    size = 0
        if held:
            yield counted(kind)

    id_type = rows.schema["_id"].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in _NUMBERS)
    return rows.mapInArrow(run, f"_id {id_type}, {longs}, groups_sha256 string, pairs array<bigint>, times array<bigint>, code bigint, n bigint")


def _weighed(aligned: DataFrame, known) -> DataFrame:  # noqa: ANN001  a broadcast
    """aligned with n_best and count_sum over the pairs that are known (sorted, their counts, whether a count is its A id's highest), and the others as `rare`."""
    names = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = known.value
        for batch in batches:
            lists = batch.column("pairs")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            deltas, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            total = np.cumsum(deltas)
            pairs = total - np.concatenate(([0], total))[ends - sizes][row]  # each text's first one is whole
            there = np.minimum(np.searchsorted(codes, pairs), max(0, len(codes) - 1))
            hit = codes[there] == pairs if len(codes) else np.zeros(len(pairs), bool)
            sums = np.zeros((2, len(pairs) + 1), np.int64)
            if len(codes):
                np.cumsum(np.where(hit & best[there], times, 0), out=sums[0, 1:])
                np.cumsum(np.where(hit, times * counts[there], 0), out=sums[1, 1:])
            per = sums[:, ends] - sums[:, ends - sizes]
            rest = np.flatnonzero(~hit)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row[rest], minlength=len(sizes))))).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(pairs[rest]), pa.array(times[rest])], ["code", "times"]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(per[0]), pa.array(per[1]), rare], [*names, "n_best", "count_sum", "rare"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in names)
    return aligned.mapInArrow(run, f"{kinds}, n_best bigint, count_sum bigint, rare array<struct<code:bigint,times:bigint>>")


def align_tokens(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", broadcast_most: int = 1 << 21) -> DataFrame:
    """One row per row of docs: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A space and the text are encoded by the byte-level vocabulary a, the text by the SentencePiece model b, which adds the space itself, without
    special tokens. Places where tokens of both end cut the bytes into groups; the tokens of a group link, each of a with each of b. An id
    pair's count is the number of rows of docs that hold it linked; n_best is the number of links whose count is the highest of their a id,
    count_sum the counts' sum over the links. groups_sha256 is of the ids by group (a1,a2|b1;a3|b2,b3), '' without tokens.
    Texts that are null, empty, or that the vocabularies' tokens don't spell byte by byte have no tokens. Rows may repeat, and count as often;
    ids may be null; other columns are ignored; no rows give no rows. Texts are taken whole.

    Spans of the libraries (character offsets, byte spans) are the coarse cuts; multibyte characters that several tokens share and tokens of
    single bytes are cut by their decoded bytes. Texts are taken apart at single spaces, over which no token reaches, and equal stretches aligned
    once while a worker remembers them; one without such spaces is aligned in one go.

    One pass over docs writes each row's numbers and its distinct linked pairs to the shared folder, with pair counts that tasks have summed already,
    which alone are shuffled; a second pass over that table adds the counts up. Up to broadcast_most pairs (2 M: 34 MB), the
    most frequent ones, are broadcast; a link of another pair goes by a shuffle, where it meets few others.
    """
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"), F.length(quoted(text_col)).alias("_size"))
    survey = staged(_survey(rows, a, b), "alignment", "zstd")
    counts = staged(survey.where("code is not null").groupBy("code").agg(F.sum("n").alias("n")), "pair-counts")
    of_a = F.shiftright("code", 32)
    highest = F.broadcast(counts.groupBy(of_a.alias("_a")).agg(F.max("n").alias("_most")))  # one row an id of a at most
    pairs = staged(counts.join(highest, of_a == F.col("_a")).select("code", "n", (F.col("n") == F.col("_most")).alias("best"), F.floor(F.log2("n")).cast("int").alias("level")), "pairs")
    sizes, room, lowest = {r.level: r.rows for r in pairs.groupBy("level").agg(F.count(F.lit(1)).alias("rows")).collect()}, broadcast_most, 64
    while lowest > 0 and sizes.get(lowest - 1, 0) <= room:
        lowest -= 1
        room -= sizes.get(lowest, 0)
    known = pairs.where(F.col("level") >= lowest).select("code", "n", "best").toArrow()  # no more than broadcast_most rows
    order = np.argsort(known["code"].to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast(tuple(known[c].to_numpy()[order] for c in ("code", "n", "best")))
    aligned = survey.where("groups_sha256 is not null").drop("code", "n")
    if lowest == 0:
        out = _weighed(aligned, sent)
    else:
        # each row by a number of its own; its rare links come back as two sums
        own = staged(_weighed(aligned, sent).withColumn("_row", F.monotonically_increasing_id()), "aligned", "zstd")
        links = own.select("_row", F.inline("rare")).join(pairs.where(F.col("level") < lowest), "code")
        rest = links.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
        added = {c: F.col(c) + F.coalesce(more, F.lit(0)) for c, more in (("n_best", "_best"), ("count_sum", "_sum"))}
        out = own.join(rest, "_row", "left").withColumns(added)
    return out.select(F.col("_id").alias(id_col), *_NUMBERS, "n_best", "count_sum", "groups_sha256")


def align_groups(texts: list[str], a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> list[list[tuple[list[int], list[int]]]]:
    """The groups of a few texts, for looking at them: for each the ids of a and b, group by group."""
    known = Stretches(a, b)
    found, _, _ = known.look_up(texts)
    split = lambda side: [int(i) for i in side.split(",")]
    return [[tuple(map(split, g.split("|"))) for g in b";".join(known.text[e] for e in own).decode().split(";")] if own else [] for own in found]
