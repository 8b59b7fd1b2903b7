"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

Merges by rank have a local property: if a token list is the encoding of its bytes, so is every prefix of that
list, and a list is an encoding exactly if each pair of neighbours is the encoding of its two tokens' bytes. So the
encoding of each byte prefix has one last token, and the last tokens of all prefixes form a tree of back pointers.
The transducer's state is what later bytes can still depend on: the last settled token and the bytes after it, with
the last token of each of their prefixes. A transition adds a byte, finds the new prefix's last token, and emits the
tokens that all prefixes that a later token can start from share: those which are followed by the opening of some
token of the vocabulary. A token is settled at the latest when more bytes than the longest token follow, which bounds
the lookahead; most are settled after a few. States and transitions are made when they are first
needed and kept. When there are many, no more are made: what follows a state that lacks a move is encoded from there
by the same law, without a record; after many such cases the machine starts again from nothing. The end of a piece
emits the rest.

A text goes through the splitting pattern in windows, which end before a single space between other characters: no
match crosses such a place. Each distinct piece goes through the transducer once, into a memo of bounded size; memo,
states and pairs together hold some 100 MB of a worker at most.

Decoding is a machine over tokens: its state is the unfinished character's bytes, and each token moves it on and gives
the text that is complete by then.

Defined results: null and empty text give no ids (n_tokens 0, digests of the empty string); equal texts give equal
rows; very long texts go the same way; an empty table gives no rows; further columns are ignored by encode_digest and
kept by nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.common import Memo, hold, slim, texts

VOCABULARY = "byte_bpe_50k.tiktoken"
#: White space as the pattern's library has it (the property White_Space).
_S = "\\t-\\r \\x85\\xa0  -     　"
#: The same matches as public_tokenizers.PATTERN for texts without numbers outside the decimal digits.
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^{_S}\w]|_)+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: A character other than white space, of which a space and another such follow.
_INNER = re.compile(rf"[^{_S}](?= [^{_S}])")
_EXOTIC = re.compile(r"[^\x00-ɏͰ-׿Ḁ-῿‐-‧‰-⁞₠-₿ぁ-ヿ丁-丂가-힣]|[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]")

_SEPARATORS = re.compile("[\x1c-\x1f]")


def pieces(text: str) -> list[str]:
    """The pattern's matches."""
    if not text.isascii() and _EXOTIC.search(text) or text.isascii() and _SEPARATORS.search(text):
        import regex

        return regex.findall(public_tokenizers.PATTERN.replace(r"\s", f"[{_S}]").replace(rf"[^[{_S}]", rf"[^{_S}").replace(rf"\S", f"[^{_S}]"), text)
    return _FAST.findall(text)


class Transducer:
    """Encodes a byte string by ranks; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 80_000):
        self.ranks, self.limit = ranks, limit
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.never = max(self.bytes_of, default=0) + 1
        #: Of each prefix of a token: twice its rank plus two (0: it is none itself), plus 1 if it opens a longer token.
        #: Only behind a prefix of the text that an opening follows can a later token start.
        self.known = {b[:k]: 1 for b in ranks for k in range(len(b))}
        for b, i in ranks.items():
            self.known[b] = self.known.get(b, 0) | (i + 1) << 1
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, tuple[tuple[int, ...], tuple[int, ...]] | None] = {}
        self.restart()

    def restart(self) -> None:
        #: A state: the settled token before (-1 at the start), the pending bytes, the last token of the encoding of each
        #: of their prefixes, and the places in them behind which the rest opens a token.
        self.states: list[tuple[int, bytes, tuple[int, ...], tuple[int, ...]]] = [(-1, b"", (), (0,))]
        self.number: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        #: By state and byte the next state, or its complement where tokens are emitted too.
        self.moves: dict[int, int] = {}
        self.emits: dict[int, tuple[int, ...]] = {}
        self.unmade = 0

    def merged(self, data: bytes, parts_left: int = 1) -> list[int]:
        """Merge by rank, lowest first and leftmost among equals, as the definition has it, while more parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > parts_left:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], self.never), i) for i in range(len(parts) - 1))
            if best == self.never:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """The tokens that stand at the token's first and at its last byte while it is merged, from the byte on.

        None if merging its bytes doesn't give the token.
        """
        if token not in self.spines:
            data = self.bytes_of[token]
            own: tuple | None = ((token,), (token,))
            if len(data) > 1:
                halves = self.merged(data, 2)
                whole = len(halves) == 2 and self.merged(data) == [token]
                left, right = map(self.spine, halves) if whole else (None, None)
                own = (*left[:1], *right[1:]) if left and right else None
                own = ((*own[0], token), (*own[1], token)) if own else None
            self.spines[token] = own
        return self.spines[token]

    def fit(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the encoding of their bytes; a is -1 at the start."""
        key = (a + 1) * self.never + b
        known = self.pairs.get(key)
        if known is None:
            known = self._fit(a, b)
            if len(self.pairs) < 4 * self.limit:
                self.pairs[key] = known
        return known

    def _fit(self, a: int, b: int) -> bool:
        behind = self.spine(b)
        if a < 0 or behind is None:
            return behind is not None
        ahead = self.spine(a)
        if ahead is None:
            return False
        ends, starts = ahead[1], behind[0]
        if list(ends) != sorted(ends) or list(starts) != sorted(starts):  # ranks that no training gives
            return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        # Over time the tokens beside the border grow; a merge across it comes if its rank is next before both.
        i, j, last_i, last_j = 0, 0, len(ends) - 1, len(starts) - 1
        while True:
            grows_left = ends[i + 1] if i < last_i else self.never
            grows_right = starts[j + 1] if j < last_j else self.never
            across = self.ranks.get(self.bytes_of[ends[i]] + self.bytes_of[starts[j]])
            if across is not None and across < grows_left and across <= grows_right:
                return False
            if i == last_i and j == last_j:
                return True
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1

    def rest(self, state: int, data: bytes) -> list[int]:
        """The tokens that are left when a piece ends with data behind a state; no states are made for that."""
        before, pending, last, places = self.states[state]
        known, pairs, never, fit = self.known, self.pairs, self.never, self.fit
        text, ends, tokens = pending + data, len(pending) + len(data), list(last)
        for end in range(len(pending) + 1, ends + 1):
            token, still = None, []
            for at in places:
                found = known.get(text[at:end])
                if found is None:
                    continue
                if found & 1:
                    still.append(at)
                if token is None and found > 1:
                    found = (found >> 1) - 1
                    ahead = tokens[at - 1] if at else before
                    fits = pairs.get((ahead + 1) * never + found)
                    if fits or fits is None and fit(ahead, found):
                        token = found
                        if end == ends:
                            break
            if token is None:
                raise ValueError("the vocabulary lacks single bytes")
            tokens.append(token)
            still.append(end)
            places = still
        out = []
        while ends:
            out.append(tokens[ends - 1])
            ends -= len(self.bytes_of[tokens[ends - 1]])
        return out[::-1]

    def _firsts(self, last: tuple[int, ...]) -> list[int]:
        """Where the first token of the encoding of each pending prefix ends."""
        out: list[int] = []
        for p, token in enumerate(last, 1):
            start = p - len(self.bytes_of[token])
            out.append(out[start - 1] if start > 0 else p if start == 0 else -1)  # -1: it began in what is settled
        return out

    def step(self, state: int, byte: int) -> int:
        """The transition of a state by a byte, made and recorded."""
        before, pending, last, places = self.states[state]
        pending += bytes((byte,))
        token, still = None, []
        for at in places:
            found = self.known.get(pending[at:], 0)
            if found & 1:
                still.append(at)
            if token is None and found > 1 and self.fit(last[at - 1] if at else before, (found >> 1) - 1):
                token = (found >> 1) - 1
        if token is None:
            raise ValueError("the vocabulary lacks single bytes")
        last += (token,)
        still.append(len(pending))
        # Later tokens start only behind these places. A first token that the encodings up to all of them share is settled.
        emitted: list[int] = []
        while pending and still[0]:
            firsts = self._firsts(last)
            end = firsts[still[0] - 1]
            if any(firsts[p - 1] != end for p in still):
                break
            emitted.append(last[end - 1])
            before, pending, last, still = last[end - 1], pending[end:], last[end:], [p - end for p in still]
        to = self.number.get((before, pending))
        if to is None:
            to = self.number[before, pending] = len(self.states)
            self.states.append((before, pending, last, tuple(still)))
        key = state << 8 | byte
        if emitted:
            self.emits[key] = tuple(emitted)
            to = ~to
        self.moves[key] = to
        return to

    def encode(self, data: bytes) -> list[int]:
        state, out, moves, emits = 0, [], self.moves, self.emits
        for at, byte in enumerate(data[:-1]):
            to = moves.get(state << 8 | byte)
            if to is None:
                if len(self.states) >= self.limit:
                    self.unmade += 1
                    out += self.rest(state, data[at:])
                    if self.unmade > 50 * self.limit:  # the texts may have changed since
                        self.restart()
                    return out
                to = self.step(state, byte)
            if to < 0:
                out += emits[state << 8 | byte]
                to = ~to
            state = to
        return out + self.rest(state, data[-1:]) if data else out


class Utf8Stream:
    """Incremental UTF-8: feed() gives the text that is complete so far; a cut character waits for its rest.

    The machine's state is the tail of bytes of an unfinished character (none to three bytes); whole characters
    before it are decoded at once. Bytes that can't be part of any character become U+FFFD.
    """

    def __init__(self, tail: bytes = b""):
        self.tail = tail

    def feed(self, data: bytes) -> str:
        data = self.tail + data
        cut = len(data)
        for k in range(1, min(3, len(data)) + 1):
            lead = data[-k]
            if lead & 0xC0 != 0x80:  # the last character starts here
                need = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
                if need > k:
                    cut = len(data) - k
                break
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.tail = self.tail.decode("utf-8", "replace"), b""
        return out


class TokenDecoder:
    """The UTF-8 machine over tokens: a move by a token gives the text complete by then and the next tail.

    Moves from the empty tail that end in it need no more than the token's own text; all others are made by Utf8Stream
    when they are first needed and kept (tails have at most three bytes).
    """

    def __init__(self, token: list[bytes]):
        self.token = token
        self.whole: list[str | None] = []
        for data in token:
            stream = Utf8Stream()
            text = stream.feed(data)
            self.whole.append(None if stream.tail else text)
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    def feed(self, tail: bytes, i: int) -> tuple[str, bytes]:
        move = self.moves.get((tail, i))
        if move is None:
            stream = Utf8Stream(tail)
            move = (stream.feed(self.token[i]), stream.tail)
            if len(self.moves) < 50_000:
                self.moves[tail, i] = move
        return move

    def parts(self, ids: list[int], tail: bytes = b"") -> tuple[list[str], bytes]:
        """What each token completes, and the tail behind the last."""
        parts = list(map(self.whole.__getitem__, ids))
        if tail or None in parts:
            for at, i in enumerate(ids):
                if tail or parts[at] is None:
                    parts[at], tail = self.feed(tail, i)
        return parts, tail

    def decode(self, ids: list[int]) -> str:
        """The text of ids, token by token."""
        parts, tail = self.parts(ids)
        return "".join(parts) + Utf8Stream(tail).close()


class Strings:
    """A byte string for each id, all in one array."""

    def __init__(self, parts: list[bytes]):
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.fromiter(map(len, parts), np.int32, len(parts))
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        ends = np.cumsum(n, dtype=np.int32)
        if not len(ids):
            return self.flat[:0]
        return self.flat[np.arange(ends[-1], dtype=np.int32) + np.repeat(self.start[ids] - (ends - n), n)]


class Codec:
    """Texts to ids and back, with bounded memos."""

    def __init__(self, path: str, window: int = 1 << 16):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.machine, self.window = Transducer(self.ranks), window
        self.piece = Memo(200_000)
        listed = [self.machine.bytes_of.get(i, b"") for i in range(self.machine.never)]
        self.decoder, self.bytes, self.decimal = TokenDecoder(listed), Strings(listed), Strings([b"%d " % i for i in range(len(listed))])

    def windows(self, text: str) -> Iterator[str]:
        """The text in parts of about a window; a part ends before a space between characters other than white space."""
        at = 0
        while len(text) - at > self.window:
            place = _INNER.search(text, at + self.window)
            if place is None:
                break
            yield text[at : place.end()]
            at = place.end()
        yield text[at:] if at else text

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """The ids, window by window."""
        piece = self.piece
        for part in self.windows(text):
            found = pieces(part)
            ids = list(map(piece.get, found))
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                ids[at] = self._piece(found[at])
            yield np.frombuffer(b"".join(ids), np.int32)

    def _piece(self, piece: str) -> bytes:
        ids = self.piece.get(piece) or self.piece.fetch(piece)
        if ids is None:
            ids = array("i", self.machine.encode(piece.encode())).tobytes()
            if len(piece) < 64:
                self.piece.keep(piece, ids)
        return ids

    def digests(self, text: str) -> tuple[int, str, str, int]:
        """Of a text: how many ids, the digests of the ids and of their bytes, and the characters decoded again."""
        n, chars, tail, ids_digest, bytes_digest = 0, 0, b"", hashlib.sha256(), hashlib.sha256()
        before = b""
        for ids in self.encode(text):
            n += len(ids)
            if before:
                ids_digest.update(before)
            before = self.decimal.joined(ids).tobytes()
            bytes_digest.update(self.bytes.joined(ids))
            parts, tail = self.decoder.parts(ids.tolist(), tail)
            chars += len("".join(parts))
        ids_digest.update(before[:-1])
        return n, ids_digest.hexdigest(), bytes_digest.hexdigest(), chars + (len(Utf8Stream(tail).close()) if tail else 0)


_CODECS: dict[str, Codec] = {}


def codec(vocabulary: str = VOCABULARY) -> Codec:
    """The worker's codec of a vocabulary file of public_tokenizers."""
    hold("bpe", _CODECS.clear)
    if vocabulary not in _CODECS:
        _CODECS[vocabulary] = Codec(public_tokenizers.path(vocabulary))
    return _CODECS[vocabulary]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): each text's token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            ids = [np.concatenate(list(own.encode(t.decode("utf-8", "replace")))) for t in texts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return slim(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), streamed token by token through the UTF-8 machine; null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary).decoder
        for batch in batches:
            out = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_chars) of every document.

    Each text is encoded, and its ids decoded again: decoded_sha256 is of the bytes of the tokens, decoded_chars is
    the length of the text that the streaming decoder makes of them token by token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            found = [own.digests(t.decode("utf-8", "replace")) for t in texts(batch, 1)]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"])

    return slim(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long")
