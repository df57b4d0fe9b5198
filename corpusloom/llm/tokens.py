"""Token ids of public tokenizers inside Spark tasks.

Ids come from the `tokenizers` library. Prose repeats its words, so a worker cuts a whole Arrow batch of texts into
chunks at once, asks the library only for chunks it hasn't met, and puts the ids together by array look-ups. A cut is
made only where both tokenizers' own patterns always part a text: before white space, and between letters, digits and other
signs, but not behind an apostrophe, which may begin a contraction. That holds for printable ASCII, tabs,
line ends and Western European letters; a text with any other character, or with an added token's string, goes to the library whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Chunks that a worker remembers at most, and the longest of them in bytes; longer ones are asked for anew. Each takes about 40 bytes,
#: and as much again several times over while new ones are looked up and put beside them.
CACHE_CHUNKS = 200_000
CACHE_BYTES = 64

_ODD, _WHITE, _LETTER, _DIGIT, _SIGN = range(5)


def _classes() -> np.ndarray:
    """Class of each byte of UTF-8. Letters above ASCII begin with C3 or C5; which of them are taken is checked beside."""
    c = np.full(256, _ODD, np.uint8)
    c[33:127] = _SIGN
    c[[9, 10, 13, 32]] = _WHITE
    c[48:58] = _DIGIT
    c[65:91] = c[97:123] = _LETTER
    c[0x80:0xC0] = c[[0xC3, 0xC5]] = _LETTER
    return c


_CLASS = _classes()
_PLAIN = bytes(np.flatnonzero(_CLASS != _ODD).astype(np.uint8))


def utf8_parts(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def binary_column(raw: np.ndarray, ends: np.ndarray):
    """Bytes and offsets as an Arrow binary column, without a copy of the bytes."""
    import pyarrow as pa

    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


class ChunkEncoder:
    """Texts to ids."""

    def __init__(self, path: str, lower_words: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The library finds these strings in the raw text; a text that holds one goes to it whole.
        self.added = sorted({a.lower() if lower_words else a for a in (t.content for t in self.tokenizer.get_added_tokens_decoder().values())})
        self.lower_words = lower_words
        self.vocabulary = max([self.tokenizer.get_vocab_size(), *(i + 1 for i in self.tokenizer.get_added_tokens_decoder())])
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        # A mark that no chunk holds and that is one token between chunks, whatever stands beside it.
        marks = [f" {c} " for c in "©®°»·±"] if lower_words else ["\n"]
        self.mark, self.mark_id = next((m, ids[0]) for m in marks if len(ids := self.tokenizer.encode(m, add_special_tokens=False).ids) == 1)
        self.forget()

    def forget(self) -> None:
        import pyarrow as pa

        self.chunks = pa.array([], pa.binary())
        self.pool = np.zeros(0, self.dtype)
        self.first, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def ask(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def learn(self, chunks: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of many chunks in one call: they come back in order, parted by the mark's id. Parts of all ids, and of their numbers."""
        ids, sizes = [], []
        for i in range(0, len(chunks), 5000):
            some = chunks[i : i + 5000]
            got = np.asarray(self.tokenizer.encode_batch_fast([self.mark.join([c.decode() for c in some])], add_special_tokens=False)[0].ids, self.dtype)
            mark = got == self.mark_id
            ends = np.append(np.flatnonzero(mark), len(got))
            if len(ends) != len(some):
                raise ValueError("chunks and marks don't match")
            ids.append(got[~mark])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        return ids, sizes

    def keep(self, words) -> np.ndarray:
        """Learns chunks, an Arrow binary column without repeats; their numbers in the pool."""
        import pyarrow as pa

        chunks = words.to_pylist()
        # Whole texts are asked for as they are, and so is white space, which would run into the mark.
        alone = np.array([len(c) > CACHE_BYTES or c[-1] in b" \n\t\r" or c[0] in b"\n\t\r" or len(c.split()) > 1 or c.translate(None, _PLAIN) != b"" or b"<|" in c for c in chunks])
        odd = np.flatnonzero(alone)
        order = np.concatenate([np.flatnonzero(~alone), odd])
        ids, sizes = self.learn([c for c, x in zip(chunks, alone.tolist(), strict=True) if not x])
        ids += [self.ask(chunks[i].decode()) for i in odd.tolist()]
        size = np.concatenate([*sizes, [len(x) for x in ids[len(ids) - len(odd) :]]]).astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = len(self.chunks) + np.arange(len(order))
        self.chunks = pa.concat_arrays([self.chunks, words.take(pa.array(order))])
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(size) - size])
        self.size, self.met = np.concatenate([self.size, size]), np.concatenate([self.met, np.zeros(len(size), np.int32)])
        self.pool = np.concatenate([self.pool, *ids])
        return place

    def shrink(self) -> None:
        """Long chunks go, and beyond CACHE_CHUNKS all but the half met most often."""
        import pyarrow.compute as pc

        stay = np.flatnonzero(pc.binary_length(self.chunks).to_numpy() <= CACHE_BYTES)
        if len(stay) > CACHE_CHUNKS:
            stay = np.sort(stay[np.argsort(-self.met[stay], kind="stable")[: CACHE_CHUNKS // 2]])
            self.met[stay] //= 2
        if len(stay) < len(self.chunks):
            self.chunks, self.met = self.chunks.take(stay), self.met[stay]
            self.pool = expand(self.pool, self.first[stay], self.size[stay])
            self.size = self.size[stay]
            self.first = np.cumsum(self.size) - self.size

    def numbers(self, chunks) -> np.ndarray:
        """Where each of the chunks, an Arrow binary column, stands in the pool; new ones are learned."""
        import pyarrow as pa
        import pyarrow.compute as pc

        coded = chunks.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.chunks)
        at = pc.fill_null(known, -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self.keep(coded.dictionary.take(pa.array(new)))
        self.met[at] += 1
        return at[coded.indices.to_numpy()]

    def whole(self, texts, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which texts go to the library as they are."""
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = _CLASS[raw]
        bad = kind == _ODD
        for lead, fine in ((0xC3, lambda x: (x != 0x97) & (x != 0xB7)), (0xC5, lambda x: (x == 0x92) | (x == 0x93))):
            at = np.flatnonzero(raw == lead)
            bad[at[~fine(raw[np.minimum(at + 1, len(raw) - 1)])]] = True
        out = np.zeros(len(ends) - 1, bool)
        out[np.searchsorted(ends, np.flatnonzero(bad), "right") - 1] = True
        if self.added:
            start = self.added[0][:2] if len({a[:2] for a in self.added}) == 1 else ""
            hint = pc.fill_null(pc.match_substring(texts, start), False).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(hint).tolist():
                t = texts[i].as_py()
                t = t.lower() if self.lower_words else t
                out[i] |= any(a in t for a in self.added)
        return out

    def cuts(self, raw: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Where chunks begin."""
        n = len(raw)
        kind = _CLASS[raw]
        white = kind == _WHITE
        new = np.zeros(n + 1, bool)
        new[1:n] = (kind[1:] != kind[:-1]) & (raw[:-1] != 39)
        new[1:n] &= ~white[:-1]  # what follows white space is decided here
        if not self.lower_words:
            # The last of a run of white space stands alone or, a space, with what follows; not at a text's end.
            last = np.zeros(n + 1, bool)
            last[: n - 1] = white[:-1] & ~white[1:]
            last[ends[1:] - 1] = False
            new |= last
            new[1:] |= last[:-1] & (raw != 32)
        new[np.minimum(ends[:-1], n)] = True
        for i in np.flatnonzero(whole).tolist():
            new[ends[i] + 1 : ends[i + 1]] = False
        return np.flatnonzero(new[:n])

    def encode(self, texts, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column, one after the other, each followed by end_id if there is one, and their numbers."""
        raw, ends = utf8_parts(texts)
        starts, first, size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(raw):
            starts = self.cuts(raw, ends, self.whole(texts, raw, ends))
            at = self.numbers(binary_column(raw, np.append(starts, len(raw))))
            first, size = self.first[at], self.size[at]
        stop, pool = np.searchsorted(starts, ends[1:]), self.pool
        if end_id is not None:
            first, size = np.insert(first, stop, len(pool)), np.insert(size, stop, 1)
            pool = np.append(pool, self.dtype.type(end_id))
            stop = stop + np.arange(1, len(stop) + 1)
        ids = expand(pool, first, size)
        bounds = np.concatenate([[0], np.cumsum(size)])[stop]
        self.shrink()
        return ids, np.diff(bounds, prepend=0)


def expand(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[first : first + size] of all rows, one after the other."""
    upto = np.cumsum(size)
    return pool[np.repeat(first - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, lower_words: bool = False) -> ChunkEncoder:
    """One encoder for each worker process, loaded at its first use."""
    key = (path, lower_words)
    if key not in _ENCODERS:
        import gc
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[key] = ChunkEncoder(path, lower_words)
        gc.freeze()
    return _ENCODERS[key]


def slices(batches: Iterator, bytes_at_once: int = 2_000_000) -> Iterator:
    """Arrow batches put together or cut so that a slice holds about so many bytes; a longer text is a slice of its own."""
    import pyarrow as pa

    def even(held):
        b = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        per = -(-b.num_rows // max(1, round(b.nbytes / bytes_at_once)))
        for i in range(0, b.num_rows, per):
            yield b.slice(i, per)

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= bytes_at_once * 3 // 4:
            yield from even(held)
            held, size = [], 0
    if held:
        yield from even(held)


def default_path(name: str) -> Callable[[], str]:
    import public_tokenizers

    return public_tokenizers.path(name)
