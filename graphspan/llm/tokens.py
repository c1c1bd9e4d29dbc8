"""Byte-level BPE encoding and decoding with the tokenizers library.

Arrow batches are cut into the pattern's matches, which are encoded one by one, so each
distinct match of a batch needs encoding only once: Arrow's dictionary encoding finds
the distinct ones, and a bounded table keeps the ids of matches already seen. Cutting
looks at the classes of characters below U+0250. Around others the library cuts itself:
the text between two spaces that each stand in front of a non-space character, where a
match always begins, is given to it whole.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Matches in one generation of a worker process's table.
KEPT_PIECES = 200_000
#: A match is kept from its second batch on, as far as a table of so many hashes tells.
SEEN_HASHES = 1 << 21
#: Longer matches are encoded afresh.
KEPT_CHARS = 64
#: Bytes of text cut at once; longer texts are parted in front of words.
CUT_BYTES = 2 << 20
#: From this character on only the library tells classes.
_FOREIGN = 0x250
_LETTER, _NUMBER, _OTHER, _WHITE, _UNKNOWN = range(5)
_PART = re.compile(rb" (?=[A-Za-z])")


def byte_to_char() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others, in order, for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str):
    """A tokenizers model that merges as the ranks say: whole matches found in the
    vocabulary become one id; else the adjacent pair whose joined bytes have the lowest
    rank is joined first. A token may arise from several pairs, so all its splits into
    two tokens are merges, in the order of the joined token's rank."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_to_char()
    shown = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for t, _ in sorted(ranks.items(), key=lambda x: x[1]):
        merges += [(shown[t[:i]], shown[t[i:]]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    out = Tokenizer(model)
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def tokenizer_of_file(path: str):
    """The tokenizer of a JSON file; strings of special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


class _Kept(dict):
    """Ids of matches. Two generations of at most `kept` matches: a full table becomes the
    old one, from which matches in use are taken over. Matches that occur in one batch only,
    most of a large corpus's, take no place in it."""

    def __init__(self, ids_of: Callable[[bytes], bytes], kept: int):
        super().__init__()
        self.ids_of, self.kept, self.old = ids_of, kept, {}
        self.seen = bytearray(SEEN_HASHES // 8)

    def __missing__(self, match: bytes) -> bytes:
        ids = self.old.get(match)
        if ids is None:
            ids = self.ids_of(match)
            h = hash(match) % SEEN_HASHES
            bit = 1 << (h & 7)
            if not self.seen[h >> 3] & bit:
                self.seen[h >> 3] |= bit
                return ids
        if len(match) <= KEPT_CHARS:
            if len(self) >= self.kept:
                self.old = dict(self)
                self.clear()
                self.seen = bytearray(SEEN_HASHES // 8)
            self[match] = ids
        return ids


def character_classes() -> np.ndarray:
    """Class of each character below U+0250 as the pattern knows them."""
    import regex

    kinds = [(regex.compile(p), k) for p, k in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _WHITE), (r"[^\s\p{L}\p{N}]", _OTHER))]
    return np.array([next(k for p, k in kinds if p.match(chr(c))) for c in range(_FOREIGN)], np.uint8)


def match_starts(data: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sorted bytes at which matches of the byte-level pattern begin in UTF-8 texts put one
    behind the other (starts: the first byte of each that is not empty). Between two spaces in front
    of known non-spaces, text that holds a character from U+0250 on is one match."""
    wide = bool((data >= 0x80).any())
    at = np.flatnonzero((data & 0xC0) != 0x80) if wide else None
    lead = data[at] if wide else data
    if wide:
        cls = classes[np.minimum(lead, 0x7F)]
        two = np.flatnonzero(lead >= 0x80)
        # C2 80 to C9 8F are the characters from U+0080 to U+024F
        code = ((lead[two].astype(np.int32) & 0x1F) << 6) | (data[at[two] + 1] & 0x3F)
        known = (lead[two] < 0xE0) & (code < _FOREIGN)
        cls[two] = np.where(known, classes[np.where(known, code, 0)], _UNKNOWN)
    else:
        cls = classes[lead]
    n = len(cls)
    first = np.zeros(n + 1, bool)  # of a text
    first[np.searchsorted(at, starts) if wide else starts] = True
    first[n] = True
    white = cls == _WHITE
    new = np.empty(n, bool)  # a run of one class begins
    new[1:] = cls[1:] != cls[:-1]
    new |= first[:n]
    space = lead == 0x20
    begins = new.copy()
    # the last of several white characters is no part of the match before, unless the text ends
    stands = np.zeros(n, bool)  # white in front of a non-white character of the same text
    stands[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    begins |= stands
    glued = np.flatnonzero(stands & space) + 1  # a space belongs to the run behind it
    begins[glued] = False
    # 's 't 'm 'd 're 've 'll behind anything but a space
    q = np.flatnonzero((lead == 0x27) & begins)
    q = q[q + 1 < n]
    q = q[~first[q + 1]]
    if len(q):
        one = lead[q + 1]
        after = np.minimum(q + 2, n - 1)
        two = np.where((q + 2 < n) & ~first[np.minimum(q + 2, n)], lead[after], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        for chosen, length in ((q[short], 2), (q[long & ~short], 3)):
            begins[chosen + 1] = False
            rest = chosen + length
            rest = rest[rest < n]
            begins[rest[(cls[rest] == _LETTER) & ~first[rest]]] = True
    if wide and (odd := np.flatnonzero(cls == _UNKNOWN)).size:
        safe = first[:n].copy()
        safe[:-1] |= stands[:-1] & space[:-1] & (cls[1:] != _UNKNOWN)
        number = np.cumsum(safe)
        foreign = np.zeros(int(number[-1]) + 1, bool)
        foreign[number[odd]] = True
        begins &= ~foreign[number] | safe
    out = np.flatnonzero(begins)
    return at[out] if wide else out


class Encoder:
    """Texts to ids (numpy uint32), through a bounded table of matches."""

    def __init__(self, tokenizer, kept: int = KEPT_PIECES):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.chars = byte_to_char()
        self.classes = character_classes()
        self.packed = [struct.pack("<I", i) for i in range(max(tokenizer.get_vocab().values()) + 1)]
        self.known = _Kept(self._ids, kept)
        self.lengths: np.ndarray | None = None

    def _ids(self, match: bytes) -> bytes:
        if max(match) >= 0xC9 and max(text := match.decode()) >= chr(_FOREIGN):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        plain = match[match[0] == 0x20 :]
        shown = self.chars[0x20] * (match[0] == 0x20) + (plain.decode() if plain.isalnum() else plain.decode("latin-1").translate(self.chars))
        return b"".join([self.packed[t.id] for t in self.model.tokenize(shown)])

    def _cut(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, and the number of ids of each."""
        lengths = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(lengths)
        buffer = b"".join(parts)
        if not buffer:
            return np.empty(0, "<u4"), np.zeros(len(parts), np.int64)
        starts = match_starts(np.frombuffer(buffer, np.uint8), (ends - lengths)[lengths > 0], self.classes)
        offsets = np.append(starts, len(buffer)).astype(np.int32)
        matches = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)]).dictionary_encode()
        found = list(map(self.known.__getitem__, matches.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        which = matches.indices.to_numpy()
        n = sizes[which]
        behind = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - (behind - n), n) + np.arange(int(behind[-1]))
        ids = np.frombuffer(b"".join(found), "<u4")[at]
        upto = np.append(0, behind)[np.searchsorted(starts, ends)]
        return ids, np.diff(upto, prepend=0)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text. Null counts as empty; an empty text has no ids."""
        held: list[bytes] = []
        owners: list[int] = []  # parts of each text held
        size = 0

        def done() -> Iterator[np.ndarray]:
            ids, n = self._cut(held)
            ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(owners))]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield ids[a:b]

        for text in texts:
            own = (text or "").encode()
            if len(own) > CUT_BYTES:
                yield from done() if held else ()
                held, owners, size = [], [], 0
                yield self._long(own)
                continue
            held.append(own)
            owners.append(1)
            size += len(own)
            if size > CUT_BYTES:
                yield from done()
                held, owners, size = [], [], 0
        if held:
            yield from done()

    def _long(self, text: bytes) -> np.ndarray:
        """Ids of a text that is cut in front of words, part by part."""
        out, a = [], 0
        while a < len(text):
            m = _PART.search(text, a + CUT_BYTES)
            b = m.start() if m else len(text)
            out.append(self._cut([text[a:b]])[0])
            a = b
        return np.concatenate(out)

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """The byte in the UTF-8 text at which each id starts."""
        if self.lengths is None:
            self.lengths = np.array([len(b) for b in token_bytes(self.tokenizer)], dtype=np.int64)
        n = self.lengths[ids]
        return np.cumsum(n) - n


def token_bytes(tokenizer) -> list[bytes]:
    """Bytes of every id: the reverse of the byte-level alphabet. Ids that stand for no
    bytes (specials) give the bytes of their string."""
    back = {c: b for b, c in byte_to_char().items()}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def decode_bytes(ids, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def decode_stream(chunks: Iterator[list[int]], table: list[bytes]) -> Iterator[str]:
    """Texts of successive id chunks. A character whose bytes are split between chunks
    comes with the later one; bytes that form no character become U+FFFD."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for chunk in chunks:
        yield decoder.decode(decode_bytes(chunk, table))
    if rest := decoder.decode(b"", final=True):
        yield rest


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process and vocabulary: of ranks (.tiktoken), or a
    tokenizer's JSON file."""
    key = (path, pattern)
    if key not in _encoders:
        _encoders.clear()
        made = tokenizer_of_file(path) if path.endswith(".json") else tokenizer_of_ranks(read_ranks(path), pattern)
        _encoders[key] = Encoder(made)
    return _encoders[key]


def forget() -> None:
    """Free a worker process's tables, before another operator fills its own."""
    _encoders.clear()
