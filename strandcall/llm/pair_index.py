"""Byte-level BPE by a pair occurrence index.

The distinct words of a slice of a partition lie behind one another in one array of
symbols. An index holds for every pair of neighbours that a merge joins all its
positions, under the rank of the merge. Active ranks are applied in ascending
order, each at all its positions at once; the pairs that arise beside them join the
lists of their own ranks. As a merge only uses symbols of earlier merges (checked
when a vocabulary is read), a rank that is done never comes back, and the work is
in proportion to the symbols, however long a word is.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcall.llm.common import ship

SLICE = 1 << 23  # characters of text that are encoded together
PIECE = 1 << 20  # a longer text is split into words in pieces of about this length
KNOWN = 1 << 23  # characters of words that are remembered from slice to slice
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GONE = -1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class PairIndex:
    """Merges of a vocabulary: ``symbols`` by byte, and for each rank the two parts and what they give."""

    def __init__(self, symbols: np.ndarray, parts: np.ndarray, whole: np.ndarray, size: int):
        made = np.full(size, -1, np.int64)
        made[whole] = np.arange(len(whole))
        if len(np.unique(whole)) < len(whole) or (made[parts] >= np.arange(len(whole))[:, None]).any() or (made[symbols] >= 0).any():
            raise ValueError("a merge uses the result of a later one")
        self.symbols, self.parts, self.whole, self.size = symbols, parts, whole, size
        keys = parts[:, 0] * size + parts[:, 1]
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for pairs that no merge joins."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left != GONE) & (right != GONE), self.rank_of[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words behind one another, the number of ids of each word)."""
        sizes = np.array([len(w) for w in words], np.int64)
        none = int(sizes.sum())  # a place behind the last symbol: no neighbour
        symbol = np.append(self.symbols[np.frombuffer(b"".join(words), np.uint8)], GONE).astype(np.int32)
        kind = np.int32 if none < 1 << 31 else np.int64
        after, before = np.arange(1, none + 2, dtype=kind), np.arange(-1, none, dtype=kind)
        ends = np.cumsum(sizes)[sizes > 0]
        after[none] = none
        after[ends - 1] = none
        before[ends[ends < none]] = before[:1] = none
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Take the pairs that begin at these places into the lists of their ranks."""
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, places in zip(rank[np.r_[0, cuts]].tolist() if len(rank) else (), np.split(at, cuts)):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(active, r)
                lists[r].append(places)

        add(np.arange(none, dtype=kind))
        while active:
            rank = heapq.heappop(active)
            left, right = self.parts[rank]
            at = np.unique(np.concatenate(lists.pop(rank)))
            behind = after[at]
            here = (symbol[at] == left) & (symbol[behind] == right)
            at, behind = at[here], behind[here]
            if left == right and len(at) > 1:  # of a run of the same symbol every second place, from its start
                first = np.r_[True, at[1:] != behind[:-1]]
                index = np.arange(len(at))
                here = (index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0
                at, behind = at[here], behind[here]
            symbol[at] = self.whole[rank]
            symbol[behind] = GONE
            after[at] = following = after[behind]
            before[following] = at
            symbol[none] = GONE
            add(np.concatenate([before[at], at]))
        left = symbol[:none] != GONE
        counted = np.r_[0, np.cumsum(left)][np.r_[0, np.cumsum(sizes)]]
        return symbol[:none][left], np.diff(counted)


class Numbers(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class ByteBpe:
    """A byte-level BPE vocabulary (the JSON of the tokenizers library) that encodes and decodes texts."""

    def __init__(self, path: str):
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, pre, added = told["model"], told["pre_tokenizer"], told["added_tokens"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or told["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take white space or whole words")
        vocab = model["vocab"]
        letters = byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = 1 + max([*vocab.values(), *[t["id"] for t in added]])
        numbers = lambda names: np.array([vocab[n] for n in names], np.int64)
        parts = np.stack([numbers(a for a, _ in merges), numbers(b for _, b in merges)], axis=1)
        self.index = PairIndex(numbers(letters), parts, numbers(a + b for a, b in merges), size)
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes = [b""] * size
        for name, number in [*vocab.items(), *[(t["content"], t["id"]) for t in added]]:
            known = all(c in byte_of for c in name)
            self.bytes[number] = bytes(map(byte_of.__getitem__, name)) if known else name.encode()
        self.added = {t["content"]: t["id"] for t in added}
        by_length = sorted(self.added, key=lambda c: (-len(c), c))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if added else None
        self.pattern = regex.compile(SPLIT)
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        self.old: set[str] = set()
        self.forget()

    def forget(self) -> None:
        """Start with no known words but the added tokens."""
        self.numbers = Numbers({(c,): k for k, c in enumerate(self.added)})  # tuples: no word of a text is equal to them
        self.ids = np.array(list(self.added.values()), np.int32)
        self.sizes = np.ones(len(self.added), np.int64)
        self.held = 0

    def words(self, text: str) -> list[str]:
        """The words whose bytes are merged among themselves.

        Letters that Python's table doesn't know are left to the library: tables of
        different years differ in nothing else.
        """
        import unicodedata

        unseen = set(text) - self.old
        if any(unicodedata.category(c) == "Cn" for c in unseen):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        self.old |= unseen
        return self.pattern.findall(text)

    def pieces(self, text: str) -> Iterator[str]:
        """A long text, cut between a character and a space behind it, where words end in any case."""
        start = 0
        while len(text) - start > PIECE:
            cut = text.rfind(" ", start + 1, start + PIECE)
            while cut > start and text[cut - 1].isspace():
                cut = text.rfind(" ", start + 1, cut)
            if cut <= start:
                cut = text.find(" ", start + PIECE)
                while cut >= 0 and text[cut - 1].isspace():
                    cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[start:cut]
            start = cut
        yield text[start:]

    def numbered(self, text: str) -> np.ndarray:
        """The numbers of the words of a text; new words get new ones."""
        found = []
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                found.append(np.array([self.numbers[part,]], np.int64))
            else:
                found += [np.fromiter(map(self.numbers.__getitem__, self.words(p)), np.int64) for p in self.pieces(part)]
        return np.concatenate(found)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text. What is held besides grows with the texts together, so give slices."""
        if self.held > KNOWN:
            self.forget()
        known = len(self.sizes)
        numbered = [self.numbered(t) for t in texts]
        new = [w.encode() for w in islice(self.numbers, known, None)]
        if new:
            ids, sizes = self.index.merge(new)
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.held += sum(map(len, new))
        starts = np.cumsum(self.sizes) - self.sizes
        return [self.taken(n, starts) for n in numbered]

    def taken(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        gaps = starts[numbers] - (np.cumsum(sizes) - sizes)
        return self.ids[np.repeat(gaps, sizes) + np.arange(int(sizes.sum()))]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(1)
def vocabulary(path: str) -> ByteBpe:
    """Read once by a Python worker."""
    return ByteBpe(path)


def file_of(model: str, path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path(model)


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in order, together up to ``most``, or a single longer one."""
    start, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def lengths(column: pa.Array) -> np.ndarray:
    """The bytes of each value, 0 for null."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0))


def encode(
    docs: DataFrame, model: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    decoded: bool = False,
) -> DataFrame:
    """(doc_id, ids binary): each row's tokens as little-endian unsigned 32-bit integers, as token files hold them.

    ``model`` is a file of the public tokenizers on the executors, unless ``path``
    names another file there. No tokens are added, cut off or filled up; an added token's
    string in a text is that token, as the library's default has it. Null and empty texts have no
    tokens. Rows are encoded one by one: repeated rows, null ids and ties alike, and an empty table gives
    no rows. A text may have any length; its task holds it as a whole. ``decoded`` adds what ``decode`` gives
    for the ids, in the same Python worker.
    """
    names = ["doc_id", "ids", "text"] if decoded else ["doc_id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(file_of(model, path))
        for whole in batches:
            for batch in slices(whole, lengths(whole.column(1)), SLICE):
                found = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
                columns = [batch.column(0), pa.array([f.astype("<u4").tobytes() for f in found], pa.binary())]
                if decoded:
                    columns.append(texts_of(bpe, columns[1]))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, ids binary" + ", text string" * decoded)


def texts_of(bpe: ByteBpe, ids: pa.Array) -> pa.Array:
    return pa.array([bpe.decode(np.frombuffer(b or b"", "<u4").tolist()) for b in ids.to_pylist()], pa.string())


def decode(encoded: DataFrame, model: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the rows of ``encode`` with the text that their ids stand for, added tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(file_of(model, path))
        for whole in batches:
            for batch in slices(whole, lengths(whole.column(1)), SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts_of(bpe, batch.column(1))], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")


ship(__name__)
