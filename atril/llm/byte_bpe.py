"""Byte-level BPE as a lazily determinised transducer (operator 6).

A merge table decides, for every prefix of a piece, which token its encoding ends with: the only one that
may follow the encoding before it.  While a piece is read, several starts of an unfinished token are open;
a state holds them with the tokens not yet common to all.  A transition on a byte advances the open starts,
adds the token ending here and emits what has become common, so output waits for one token length at most.
States and transitions are built when first met and dropped together when there are too many.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import chain

import regex
from pyspark.sql import DataFrame

from atril.llm.common import arrow_map, corpus_text

MAX_STATES = 200_000
MAX_CHUNKS = 600_000
DECODE_BLOCK = 16_384
#: A single space between two other characters always opens a new match of the pattern.
_GAP = regex.compile(r"(?<=[^\s\x1c-\x1f\x85\xa0]) (?=[^\s\x1c-\x1f\x85\xa0])")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int], few: int = 1) -> list[int]:
    """Ranks of `piece` by merging the lowest pair first, until `few` parts are left; used on tokens only."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > few:
        found = [(ranks.get(parts[i] + parts[i + 1]), i) for i in range(len(parts) - 1)]
        found = [x for x in found if x[0] is not None]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class _State:
    __slots__ = ("open", "step", "rest")

    def __init__(self, open_starts):
        self.open = open_starts  # (place in the token tree, last token, tokens not emitted), oldest start first
        self.step = {}
        self.rest = open_starts[-1][2]


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.tree: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        for token, rank in ranks.items():
            at = 0
            for byte in token:
                if byte not in self.tree[at]:
                    self.tree[at][byte] = len(self.tree)
                    self.tree.append({})
                    self.ends.append(None)
                at = self.tree[at][byte]
            self.ends[at] = rank
        self.pairs: dict[int, bool] = {}
        self.judged = bytearray(len(self.tree))  # places whose token is known to encode itself, or was taken out
        self.states: dict[tuple, _State] = {}
        self.halves: dict[int, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        for state in self.states.values():
            state.step.clear()  # they name each other in rings
        self.states: dict[tuple, _State] = {}
        self.start = self._state(((0, None, ()),))

    def _state(self, key: tuple) -> _State:
        if key not in self.states:
            self.states[key] = _State(key)
        return self.states[key]

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens, each of which encodes itself."""
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[pair] = self._apart(left, right)
        return known

    def _end(self, place: int) -> int | None:
        """The token that ends at a place of the tree, if it encodes itself."""
        if not self.judged[place]:
            self.judged[place] = 1
            if (end := self.ends[place]) is not None and merge(self.token[end], self.ranks) != [end]:
                self.ends[place] = None
        return self.ends[place]

    def _halves(self, token: int) -> list[int]:
        """The two tokens that merge into `token` last; of a single byte itself alone."""
        if token not in self.halves:
            self.halves[token] = merge(self.token[token], self.ranks, 2)
        return self.halves[token]

    def _apart(self, left: int, right: int) -> bool:
        """Whether two tokens that encode themselves stay apart: no pair across the border merges earlier than
        its tokens go up in larger ones.  The later one of both is taken back by a merge at a time."""
        a, b, until = left, right, None
        while True:
            met = self.ranks.get(self.token[a] + self.token[b])
            if met is not None and (until is None or met < until):
                return False
            for side in ((0, 1) if a > b else (1, 0)):
                halves = self._halves(b if side else a)
                if len(halves) == 2:
                    if side:
                        b, until = halves[0], b + 1
                    else:
                        a, until = halves[1], a
                    break
            else:
                return True

    def _advance(self, state: _State, byte: int) -> tuple[tuple[int, ...], _State]:
        ahead, last, tree = [], None, self.tree
        for place, token, waiting in state.open:
            place = tree[place].get(byte)
            if place is None:
                continue
            if last is None and (end := self._end(place)) is not None and (token is None or self.follows(token, end)):
                last = (0, end, (*waiting, end))
            if tree[place]:
                ahead.append((place, token, waiting))
        if last is None:
            raise ValueError("the vocabulary lacks a byte")
        ahead.append(last)
        # What the smallest and the largest begin with, all begin with.
        waits = [w for _, _, w in ahead]
        low, high, shared = min(waits), max(waits), 0
        while shared < len(low) and low[shared] == high[shared]:
            shared += 1
        if not shared:
            return (), self._state(tuple(ahead))
        return last[2][:shared], self._state(tuple((p, t, w[shared:]) for p, t, w in ahead))

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ranks of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        state, out = self.start, []
        for byte in piece:
            step = state.step.get(byte)
            if step is None:
                if len(self.states) > MAX_STATES:
                    kept = state.open
                    self.clear()
                    state = self._state(kept)
                step = state.step[byte] = self._advance(state, byte)
            out += step[0]
            state = step[1]
        return (*out, *state.rest)


class Utf8Stream:
    """Incremental UTF-8: `feed` takes any cut of the bytes and returns the characters that are complete.

    The state between calls is the begun character (at most three bytes).  Bytes that can't begin or go on
    with a character become U+FFFD, as in a whole decode.
    """

    def __init__(self):
        self.begun = b""

    def feed(self, data: bytes, end: bool = False) -> str:
        data = self.begun + data
        keep = 0
        if not end:
            for back in range(1, min(3, len(data)) + 1):
                lead = data[-back]
                if lead >= 0xC0:
                    need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                    keep = back if back < need else 0
                    break
                if lead < 0x80:
                    break
        self.begun = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")


class _Met(dict):
    """What `make` gave for a key.  When there are many keys they become the earlier ones, and those of them not asked
    for again are dropped the next time."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.earlier = make, most, {}

    def __missing__(self, key):
        value = self.earlier.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def age(self) -> bool:
        """Whether keys were dropped."""
        if len(self) <= self.most // 2:
            return False
        self.earlier = dict(self)
        self.clear()
        return True


class Codec:
    """Encoder and decoder of one rank file; chunks met before are looked up."""

    def __init__(self, path: str, pattern: str):
        self.machine = Transducer(read_ranks(path))
        size = max(self.machine.token) + 1
        self.bytes_of = [self.machine.token.get(i, b"") for i in range(size)]
        self.digits_of = [str(i) for i in range(size)]
        space = r"\p{White_Space}"
        fixed = pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", space)
        self.pattern = regex.compile(fixed)
        self.met = _Met(self._behind_space, MAX_CHUNKS)  # chunk behind a space: its ids in decimal
        self.changed: dict[str, bytes] = {}  # chunks of `met` whose ids stand for other bytes

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        encode = self.machine.encode
        return tuple(chain.from_iterable(encode(m.encode()) for m in self.pattern.findall(chunk)))

    def _behind_space(self, chunk: str) -> str:
        ids, plain = self._chunk(" " + chunk), b" " + chunk.encode()
        back = b"".join(map(self.bytes_of.__getitem__, ids))
        if back != plain:
            self.changed[chunk] = back
        return ",".join(map(self.digits_of.__getitem__, ids))

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """`text` cut at the gaps; where every space is one, a plain split does."""
        plain = text.split(" ")
        return plain if all(plain) and list(map(str.strip, plain)) == plain else _GAP.split(text)

    def encode(self, text: str) -> list[int]:
        return list(map(int, filter(None, self.decimal(text)[0].split(","))))

    def decimal(self, text: str) -> tuple[str, bytes]:
        """(ids in decimal with commas between them, bytes the ids stand for), chunk by chunk."""
        if not text:
            return "", b""
        if self.met.age():
            self.changed = {c: back for c, back in self.changed.items() if c in self.met.earlier}
        first, *others = self._chunks(text)
        parts = list(map(self.met.__getitem__, others))
        ids = self._chunk(first)
        parts.insert(0, ",".join(map(self.digits_of.__getitem__, ids)))
        head = b"".join(map(self.bytes_of.__getitem__, ids))
        if self.changed and not self.changed.keys().isdisjoint(others):
            behind = b"".join(self.changed.get(c) or b" " + c.encode() for c in others)
        else:
            behind = " ".join(["", *others]).encode()
        return ",".join(filter(None, parts)), head + behind

    def decode(self, ids: list[int]):
        """Bytes and characters, block by block."""
        stream = Utf8Stream()
        for start in range(0, len(ids), DECODE_BLOCK):
            data = b"".join(map(self.bytes_of.__getitem__, ids[start : start + DECODE_BLOCK]))
            yield data, stream.feed(data, start + DECODE_BLOCK >= len(ids))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


@contextmanager
def _collector_off() -> Iterator[None]:
    """Nothing made here needs the collector of rings, which would walk all states again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode_decode(docs: DataFrame, path: str, pattern: str, texts: bool = False) -> DataFrame:
    """Encode every text, decode the ids again, and give both as digests (`texts`: also `ids` and `decoded`).

    `path`: rank file, which every worker can open.  Null and empty texts give no tokens and the digests of
    the empty string; repeated rows give repeated results; columns other than doc_id and text are ignored.
    """

    def rows(batch: dict[str, list]) -> dict[str, list]:
        tool = codec(path, pattern)
        with _collector_off():
            return given_out(tool, batch)

    def given_out(tool: Codec, batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for text in batch["text"]:
            ids, data = tool.decimal(text)
            out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
            ids = list(map(int, filter(None, ids.split(",")))) if texts else None
            out["ids"].append(ids)
            out["decoded"].append("".join(c for _, c in tool.decode(ids)) if texts else None)
        return {"doc_id": batch["doc_id"], **out}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(corpus_text(docs), rows, schema + ", ids array<int>, decoded string" * texts)
