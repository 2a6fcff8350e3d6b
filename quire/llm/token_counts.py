"""Token counts in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted, worker_memory

_CHUNK = 4 << 20  # bytes of text that are counted at once
_MEMORY = 72 << 20  # bytes, about, of the pieces whose counts a worker remembers: 400,000 of usual length
_KEPT = 64  # characters of a piece up to which it is remembered


def vocabulary_path(name_or_path: str) -> str:
    """A file's place: a path as it is, a bare name from the package of public tokenizers on the machine that runs this."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


#: How a vocabulary treats spaces, and so where a text may be split: "dropped" (at any space or line end), "leading" (before a single
#: space between two other characters, which goes with the word behind it) or "whole" (nowhere).
SPLITS: dict[str, Callable[[str], list[str]]] = {
    "dropped": lambda text: text.replace("\n", " ").split(" "),
    "leading": re.compile(r"(?:^|(?<=\S) (?=\S)).*?(?=(?<=\S) \S|\Z)", re.DOTALL).findall,
    "whole": lambda text: [text],
}


def spaces_of(path: str) -> str:
    """How the vocabulary of a file treats spaces: one of SPLITS. "whole", which is always right, for all that isn't known."""
    if not path.endswith(".json"):
        return "whole"
    with open(path, encoding="utf-8") as f:  # a vocabulary file on every machine, not an input
        made = json.load(f)
    pre = made.get("pre_tokenizer") or {}
    steps = [pre, *pre.get("pretokenizers", [])]
    kinds = {x.get("type") for x in steps}
    if (made.get("model") or {}).get("end_of_word_suffix") and any(x.get("type") == "Split" and x.get("behavior") == "Removed" for x in steps):
        return "dropped"
    plain = kinds <= {"ByteLevel"} and not any(x.get("add_prefix_space") for x in steps) and not made.get("normalizer")
    return "leading" if plain and kinds else "whole"


class Counter:
    """Counts tokens of one vocabulary, piece by piece. Equal pieces are encoded once, while the memory lasts; long ones aren't remembered."""

    def __init__(self, vocabulary: str, spaces: str | None) -> None:
        path = vocabulary_path(vocabulary)
        spaces = spaces or spaces_of(path)
        self.split, self.whole = SPLITS[spaces], spaces == "whole"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self.encode = lambda pieces: [len(e) for e in t.encode_batch_fast(pieces, add_special_tokens=False)]
        else:
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda pieces: [len(e) for e in s.encode(pieces, num_threads=1)]
        self.memo: dict[str, int] = {}
        self.size = 0  # bytes, about

    def count(self, texts: list[str]) -> list[int]:
        if self.whole:
            return self.encode(texts)
        pieces = [self.split(t) for t in texts]
        if self.size > _MEMORY:
            self.memo.clear()
            self.size = 0
        memo = self.memo
        new = list(set().union(*pieces).difference(memo))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            memo.update(zip(part, self.encode(part), strict=True))
        counts = [sum(map(memo.__getitem__, own)) for own in pieces]
        for p in new:
            if len(p) > _KEPT:
                del memo[p]
            else:
                self.size += 130 + 2 * len(p)
        return counts


def counter_of(vocabulary: str, spaces: str | None) -> Counter:
    """Kept by a Python worker from task to task, until one of another operator comes."""
    return worker_memory(f"counts {vocabulary} {spaces}", lambda: Counter(vocabulary, spaces))


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, spaces: str | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_bytes (UTF-8), n_tokens, over_limit.

    Counts are what the vocabulary's library gives for the whole text without begin, end or added special tokens; special strings
    inside texts count as the library's default has it. Null texts count as empty, which has no tokens. Rows may repeat; other
    columns are ignored; no rows give no rows. vocabulary: a file's path, or its name in the package of public tokenizers. spaces: one of SPLITS;
    by default what the file says of itself, and "whole" where it says nothing known.

    Only lengths come back from the tasks. A task takes texts in groups of about equal bytes, so that a batch of long texts
    needs no more memory than one of short texts; long texts are split at safe boundaries, where no token, added string or
    normalisation reaches over. Where a vocabulary treats spaces in a way that isn't known, and within a stretch without spaces, there are no such
    boundaries, so these are encoded in one go.
    """
    rows = docs.select(quoted(id_col).alias("_id"), F.coalesce(quoted(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_bytes", F.octet_length("_text").cast("bigint"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary, spaces)
        for batch in batches:
            sizes, counts, at = batch.column("_bytes").to_pylist(), [], 0
            while at < len(sizes):
                end, size = at, 0
                while end < len(sizes) and (end == at or size + sizes[end] <= _CHUNK):
                    size += sizes[end]
                    end += 1
                counts += counter.count(batch.column("_text").slice(at, end - at).to_pylist())
                at = end
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_bytes"), pa.array(counts, pa.int64())], ["_id", "_bytes", "n_tokens"])

    id_type = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"_id {id_type}, _bytes bigint, n_tokens bigint")
    return out.select(F.col("_id").alias(id_col), F.col("_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
