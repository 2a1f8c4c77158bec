"""Token counts by a sentencepiece model; huge texts in overlapping chunks that are spliced.

Chunks are encoded independently, with the offset of every token. Two neighbouring chunks are spliced
at a boundary in their overlap that both agree on and that is proven stable: right before a blank
that follows something else. No piece of the vocabulary has a blank after any other character (this
is looked up in the model), so no merge crosses such a place, and what an encoder makes of one side
doesn't depend on the other. A chunk's own edges spoil only what lies before its first and after its
last stable boundary. Where the overlap has none in common, the earlier chunk is widened until there
is one or the text ends; a model without the property gets every text whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .pretokens import in_blocks
from .workspace import table

#: Code points in a chunk and in the first try at an overlap.
CHUNK = 16_384
OVERLAP = 256
LIMIT = 4096
_BLANK = "▁"


class PieceCounter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        #: Blanks stand at the start of pieces or make up whole pieces.
        self.stable = all(_BLANK not in p.lstrip(_BLANK) for p in pieces) and len(self.model.encode("a  b")) == len(self.model.encode("a")) + len(self.model.encode(" b"))

    def _starts(self, text: str) -> list[int]:
        """Offsets of the tokens of ``text``."""
        return [a for a, _ in self.model.encode(text, return_type="offset_mapping")["offsets"]]

    @staticmethod
    def _boundaries(text: str, low: int, high: int) -> Iterator[int]:
        at = text.find(" ", max(low, 1), high)
        while at >= 0:
            if text[at - 1] not in (" ", _BLANK):
                yield at
            at = text.find(" ", at + 1, high)

    def count_long(self, text: str) -> int:
        n, total, begin = len(text), 0, 0
        starts = self._starts(text[: self.chunk + self.overlap])
        covered, from_ = min(n, self.chunk + self.overlap), 0  # the current chunk is text[begin:covered]; tokens before from_ are counted
        while covered < n:
            following = covered - self.overlap
            wide = self.overlap
            end = min(n, following + self.chunk + self.overlap)
            later = self._starts(text[following:end])
            while True:
                here = {begin + s for s in starts if begin + s >= following}
                there = {following + s for s in later}
                # a boundary needs a character before it in the later chunk, so that it begins a run of blanks there too
                cut = next((p for p in self._boundaries(text, following + 1, covered) if p in here and p in there), None)
                if cut is not None or covered == n:
                    break
                wide *= 2
                covered = min(n, following + wide)
                starts = self._starts(text[begin:covered])
                if covered > end:
                    end = min(n, covered + self.chunk)
                    later = self._starts(text[following:end])
            if cut is None:
                break
            total += bisect_left(starts, cut - begin) - bisect_left(starts, from_ - begin)
            begin, starts, covered, from_ = following, later, end, cut
        return total + len(starts) - bisect_left(starts, from_ - begin)

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = []
        for i, t in enumerate(texts):
            if self.stable and len(t) > self.chunk + self.overlap:
                out[i] = self.count_long(t)
            else:
                short.append(i)
        at = 0
        for block in in_blocks([texts[i] for i in short]):
            for ids in self.model.encode(block, num_threads=1, return_type="numpy"):
                out[short[at]] = len(ids)
                at += 1
        return out


@lru_cache(4)
def counter(path: str) -> PieceCounter:
    """One for each worker process and file."""
    return PieceCounter(path)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    Null and empty texts have no bytes and no tokens. Rows are independent of each other; extra
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n = c.counts(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pc.binary_length(batch["text"]).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
