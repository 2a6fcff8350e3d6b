"""Exact merge-type (BPE) encoding of SentencePiece models by backtracking, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted, worker_memory
from .token_counts import vocabulary_path

_MEMO = 300_000  # pairs of pieces that a worker remembers
_MEMORY = 72 << 20  # bytes, about, of the words whose pieces it remembers: 300,000 of usual length
_CHUNK = 1 << 20  # characters of text that are taken apart at once
_SPACE = "▁"


class PieceEncoder:
    """Encodes words of a BPE model whose normaliser changes nothing but spaces.

    The longest pieces at each place come from an Aho-Corasick automaton. A sequence of pieces is what merging gives if every two
    neighbours stay apart when their joined text is merged anew; so the encoder takes the longest piece that goes with the last one,
    then shorter ones, and steps back where none fits. A mark for each place keeps it from trying a failed place again.
    """

    def __init__(self, model_file: str) -> None:
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        path = vocabulary_path(model_file)
        model = proto.ModelProto()
        with open(path, "rb") as f:  # a vocabulary file on every machine, not an input
            model.ParseFromString(f.read())
        trainer, normalizer = model.trainer_spec, model.normalizer_spec
        if trainer.model_type != trainer.BPE or normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces or trainer.treat_whitespace_as_suffix or not trainer.byte_fallback:
            raise ValueError("this encoder needs a BPE model with byte fallback, whose normaliser keeps all characters")
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.decimal = [str(i) for i in range(len(model.pieces))]
        self.prefix = " " if normalizer.add_dummy_prefix else ""
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_ids = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type in (p.NORMAL, p.USER_DEFINED):
                self.ids[p.piece], self.score[p.piece] = i, p.score
            elif p.type == p.BYTE:
                self.byte_ids[int(p.piece[3:-1], 16)] = i
        if any(_SPACE in p[1:] and p.strip(_SPACE) for p in self.ids):
            raise ValueError("a piece holds a space behind another character, so words can't be encoded one by one")
        self.characters = frozenset(c for p in self.ids for c in p)
        # Only pieces that merging reaches can be in a result. From here on a piece is its id: numbers are quick to look up and small to keep.
        reached = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        self.single = {c: i for c, i in self.ids.items() if len(c) == 1}
        self.piece = {self.ids[p]: p for p in reached}
        self.size = {self.ids[p]: len(p) for p in reached}
        self.shorter = {self.ids[p]: next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in reached), -1) for p in reached}
        self.matches = ahocorasick.Automaton()  # finds pieces of two characters and more: how far before its end each starts, and its id
        for p in reached:
            if len(p) > 1:
                self.matches.add_word(p, (1 - len(p), self.ids[p]))
        self.matches.make_automaton()
        self.together: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}  # ids of four bytes each: less to keep than numbers
        self.kept = 0  # bytes, about
        # Runs of spaces whose pieces all have the lowest score are joined last, from the left. Empty for a model in which that isn't so.
        lowest = min(self.score.values())
        last = all((not p.strip(_SPACE)) == (x == lowest) and (p[1:2] != _SPACE or x == lowest) for p, x in self.score.items())
        self.runs = {len(p): i for p, i in self.ids.items() if not p.strip(_SPACE)} if last else {}
        #: Stretches that no piece reaches over: space marks with what follows up to one or a line end, or a line end.
        self.pieces_of = re.compile("▁+[^▁\n]*|[^▁\n]+|\n" if "\n" not in self.characters else "▁+[^▁]*|[^▁]+").findall

    def merge(self, text: str) -> list[str]:
        """The model's own rule: join the neighbours with the best score, the leftmost first, until none can be joined."""
        parts: list[str] = list(text)
        n, score = len(parts), self.score.get
        if n <= 24:  # looking through them all is quicker than a queue
            while n > 1:
                found = [(-x, i) for i in range(n - 1) if (x := score(parts[i] + parts[i + 1])) is not None]
                if not found:
                    break
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                n -= 1
            return parts
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                joined = parts[i] + parts[after[i]]
                if (x := score(joined)) is not None:
                    heapq.heappush(waiting, (-x, i, joined))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, joined = heapq.heappop(waiting)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != joined:
                continue  # one of the two has been joined with another part since
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p]

    def _fits(self, last: int, piece: int) -> bool:
        """Whether the two stay apart when their joined text is merged; remembered by both ids in one number."""
        if len(self.together) > _MEMO:
            self.together.clear()
        a, b = self.piece[last], self.piece[piece]
        known = self.together[last << 32 | piece] = self.merge(a + b) == [a, b]
        return known

    def _split(self, text: str) -> list[str]:
        """The pieces of a text all of whose characters are pieces."""
        return [self.piece[i] for i in self._split_ids(text)]

    def _split_ids(self, text: str) -> list[int]:
        longest = [self.single[c] for c in text]
        for end, (back, i) in self.matches.iter(text):
            longest[end + back] = i  # longer ones at the same place come later
        size, shorter, known = self.size, self.shorter, self.together.get
        out: list[int] = []
        closed = bytearray(len(text) + 1)
        at, last, i = 0, -1, longest[0]
        while True:
            end = at + size[i]
            if not closed[end]:
                fits = last < 0 or known(last << 32 | i)
                if fits is None:
                    fits = self._fits(last, i)
                if fits:
                    out.append(i)
                    if end == len(text):
                        return out
                    at, last, i = end, i, longest[end]
                    continue
            i = shorter[i]
            while i < 0:
                closed[at] = 1
                if not out:
                    return [self.ids[p] for p in self.merge(text)]  # pieces of equal score, as in runs of spaces, need the rule itself
                last = out.pop()
                at -= size[last]
                i = shorter[last]
            last = out[-1] if out else -1

    def _run(self, n: int) -> list[int]:
        """Ids of n space marks: of joins of equal score the leftmost comes first."""
        parts: list[int] = []
        for _ in range(n):
            parts.append(1)
            while len(parts) > 1 and parts[-2] + parts[-1] in self.runs:
                parts[-2:] = [parts[-2] + parts[-1]]
        return [self.runs[k] for k in parts]

    def word(self, text: str) -> list[int]:
        """Ids of a word, its space marks in front; a character that is no piece becomes its bytes."""
        known = self.characters
        if self.runs and text.startswith(_SPACE * 2):
            run = len(text) - len(text.lstrip(_SPACE))
            behind = self.word(text[run - 1 :]) if run < len(text) else []
            if behind and behind[0] == self.ids[_SPACE]:
                behind = behind[1:]
            else:
                run -= bool(behind)  # the last space goes with the word
            return self._run(run) + behind
        if known.issuperset(text) and not text.startswith(_SPACE * 2):
            return self._split_ids(text)
        ids: list[int] = []
        start = 0
        for i in range(len(text) + 1):
            if i == len(text) or text[i] not in known:
                if start < i:
                    part = text[start:i]
                    ids += [self.ids[p] for p in self.merge(part)] if part.startswith(_SPACE * 2) and not part.strip(_SPACE) else self._split_ids(part)
                if i < len(text):
                    ids += [self.byte_ids[b] for b in text[i].encode()]
                start = i + 1
        return ids

    def _words(self, text: str) -> Iterator[list[str]]:
        """The stretches that no piece reaches over, of about _CHUNK characters at a time."""
        text = (self.prefix + text).replace(" ", _SPACE) if text else ""
        at = 0
        while at < len(text):
            end = text.find(_SPACE, at + _CHUNK) if len(text) - at > _CHUNK else -1
            while end > 0 and text[end - 1] == _SPACE:  # not within a run of space marks
                end = text.find(_SPACE, end + 1)
            end = end if end > 0 else len(text)
            yield self.pieces_of(text[at:end])
            at = end

    def encode(self, text: str) -> list[int]:
        memo, parts = self.words, []
        for words in self._words(text):
            for w in words:
                known = memo.get(w)
                if known is None:
                    known = array("i", self.word(w)).tobytes()
                    if len(w) <= 64:
                        if self.kept > _MEMORY:
                            memo.clear()
                            self.kept = 0
                        memo[w] = known
                        self.kept += 190 + 2 * len(w) + len(known)
                parts.append(known)
        return array("i", b"".join(parts)).tolist()


def encoder(model_file: str) -> PieceEncoder:
    """Kept by a Python worker from task to task, until one of another operator comes."""
    return worker_memory(f"pieces {model_file}", lambda: PieceEncoder(model_file))


def encode_decode(docs: DataFrame, model_file: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", end_id: bool = True, output: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, and of `output`: ids (array of int), decoded (string), ids_sha256, decoded_sha256.

    The ids are those of the model's library for the whole text, without sampling, with an end id where asked for; decoded is what
    they decode to. Digests are lowercase hex, of the decimal ids joined by one space and of the decoded text in UTF-8. A null text
    counts as empty, which has only the end id. Rows may repeat; other columns are ignored; no rows give no rows.

    There is no shuffle; a task keeps one text at a time, and a worker the pieces of words in about _MEMORY bytes.
    """
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    arrow = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    rows = docs.select(quoted(id_col).alias("_id"), F.coalesce(quoted(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_file)
        end, decimal = [e.processor.eos_id()] if end_id else [], e.decimal.__getitem__
        for batch in batches:
            made: dict[str, list] = {c: [] for c in ("n_tokens", *output)}
            for value in batch.column("_text"):
                ids = e.encode(value.as_py()) + end
                made["n_tokens"].append(len(ids))
                if "ids" in made:
                    made["ids"].append(ids)
                if "ids_sha256" in made:
                    made["ids_sha256"].append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                if "decoded" in made or "decoded_sha256" in made:
                    decoded = e.processor.decode(ids)
                    if "decoded" in made:
                        made["decoded"].append(decoded)
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(made["n_tokens"], pa.int64()), *[pa.array(made[c], arrow[c]) for c in output]], ["_id", "n_tokens", *output])

    id_type = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(run, ", ".join([f"_id {id_type}", "n_tokens bigint", *[f"{c} {kinds[c]}" for c in output]]))
    return out.withColumnRenamed("_id", id_col)
