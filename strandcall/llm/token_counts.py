"""Exact token counts by overlap resynchronisation.

A document of more than ``CHUNK`` bytes is encoded in overlapping chunks. Tokens
have offsets, so boundaries that both chunks agree on are known; two chunks
are spliced at such a boundary if no piece of the vocabulary holds the two
characters around it side by side. No merge can then reach across, whatever
stands on either side, so that the tokens are those of the whole text. If the overlap
has no such place it is widened, up to the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcall.llm.common import modest_batches, ship, small_batches

CHUNK = 1 << 15
OVERLAP = 256
SPACE = "▁"


class PieceEncoder:
    """A sentencepiece BPE model with the byte length of every piece and the pairs of characters inside pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        texts = ["?" if self.model.is_byte(i) else p.replace(SPACE, " ") for i, p in enumerate(pieces)]
        self.sizes = np.array([len(t.encode()) for t in texts], np.int64)
        self.inside = {t[k : k + 2] for t in texts for k in range(len(t) - 1)}

    def boundaries(self, text: str) -> np.ndarray:
        """Where tokens of ``text`` end, in bytes; the space that the model puts in front is not counted."""
        return np.cumsum(self.sizes[self.model.encode(text)]) - 1

    def stable(self, data: bytes, at: int) -> bool:
        """No piece holds the characters before and behind this place side by side."""
        if not 0 < at < len(data) or data[at] & 0xC0 == 0x80:
            return False
        first = at - 1
        while data[first] & 0xC0 == 0x80:
            first -= 1
        behind = data[at : at + 4].decode("utf-8", "ignore")[0]
        return data[first:at].decode() + behind not in self.inside

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """The number of tokens of the whole text."""
        text = text.replace(SPACE, " ")  # the model takes both for the same
        data = text.encode()
        if len(data) <= chunk:
            return len(self.model.encode(text))

        def place(at: int) -> int:
            """The start of the character at this byte."""
            while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
                at -= 1
            return max(0, min(at, len(data)))

        def encoded(start: int, end: int) -> np.ndarray:
            return self.boundaries(data[start:end].decode()) + start

        start, end, done, total = 0, place(chunk), -1, 0  # a first token may be the space in front alone
        here = encoded(start, end)
        while end < len(data):
            width, found = overlap, None
            while found is None:
                following = place(end - width)
                if following <= max(done, start):  # the overlap has reached what is spliced: a longer chunk
                    end, width = place(end + max(chunk, 2 * (end - start))), overlap
                    here = encoded(start, end)
                    if end == len(data):
                        break
                    continue
                stop = place(following + chunk + width)
                there = encoded(following, stop)
                common = np.intersect1d(here, there)
                common = common[(common > following) & (common <= end)]
                found = next((int(c) for c in common[::-1] if self.stable(data, int(c))), None)
                width *= 2
            if found is None:
                break
            total += int(np.count_nonzero((here > done) & (here <= found)))
            start, end, done, here = following, stop, found, there
        return total + int(np.count_nonzero(here > done))


def token_counts(
    docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """(doc_id, n_bytes long, n_tokens long) of every row.

    ``model`` is a file of the public tokenizers on the executors, unless ``path``
    names another file there. Null and empty texts have no bytes and no tokens. Special strings
    in a text are text. Rows are counted one by one, repeated rows too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = PieceEncoder(path or public_tokenizers.path(model))
        for batch in small_batches(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            counts = pa.array([encoder.count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, counts], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return modest_batches(texts).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


ship(__name__)
