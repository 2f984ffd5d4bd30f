"""SentencePiece merge-type encoding by backtracking (operator 11).

A text's encoding is the only cut into tokens in which every token merges to itself and every two neighbours
merge to themselves again.  An Aho-Corasick pass gives the longest token that starts at each place; the
encoder takes the longest token that is compatible with its left neighbour, tries shorter prefixes when none
follows, and goes back one token when none fits.  A bit for each place remembers where nothing fits, so no
place is left twice.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame

from atril.llm.common import arrow_map, corpus_text

SPACE = "▁"
MAX_PARTS = 500_000
MAX_PAIRS = 1_000_000
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Pieces:
    """Vocabulary of a merge-type model that takes texts as they are: no folding, a space before the first character."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.end = model.eos_id()
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        self.text: list[str] = []  # of ids that are pieces, with their spaces
        self.byte: list[int | None] = []
        for i in range(model.get_piece_size()):
            piece, plain = model.id_to_piece(i), not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
            if model.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            if plain:
                self.id[piece], self.score[piece] = i, model.get_score(i)
            byte = int(_BYTE.fullmatch(piece)[1], 16) if model.is_byte(i) else None
            if byte is not None:
                self.byte_id[byte] = i
            self.byte.append(byte)
            self.text.append(piece if plain else model.decode([i]) if model.is_unknown(i) else "")
        self.bytes = set(self.byte_id.values())
        if len(self.byte_id) != 256:
            raise ValueError("the model has no piece for every byte")
        probe = "  a   éﬁＡ \n "
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("models that change texts before encoding are not supported")
        self.in_pieces = set().union(*self.id)
        self.cut = self._cuts()
        # The longest piece that ends at a place of the reversed text starts there in the text itself.
        self.longest = ahocorasick.Automaton()
        for piece in self.id:
            self.longest.add_word(piece[::-1], piece)
        self.longest.make_automaton()
        self.shorter: dict[str, str] = {}
        for piece in self.id:
            self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.id), piece[:1] if len(piece) > 1 else "")

    def _cuts(self) -> re.Pattern:
        """Pattern of parts that can be encoded apart: no piece holds the two characters on both sides of a cut.

        Cuts lie before spaces, between a word and the marks behind it (but behind characters that a piece has before
        a mark), and around line breaks; where pieces do reach across, the whole text is one part.
        """
        beside = {(p[k], p[k + 1]) for p in self.id for k in range(len(p) - 1)}
        if any(b == SPACE != a for a, b in beside):
            return re.compile(r"(?s).+")
        marks = {c for c in map(chr, range(33, 127)) if not re.match(r"\w", c)}
        reach = re.escape("".join(sorted({a for a, b in beside if b in marks and re.match(r"\w", a)})))
        line = "" if "\n" in self.in_pieces else "\n"
        head = rf"{SPACE}*[^\W{reach}]+(?=[{re.escape(''.join(sorted(marks)))}])|"
        return re.compile(rf"{head}{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + (f"|{line}" if line else ""))

    def merged(self, text: str) -> list[str]:
        """`text` by merging its best pair again and again, the first of equals; used on pairs of tokens only."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts


class Encoder:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.met: dict[str, str] = {}  # part of a text: its ids in decimal
        self.changed: dict[str, str] = {}  # parts of `met` that decode to something else

    def follows(self, left: str, right: str) -> bool:
        """Whether `left` and `right` (`left` empty: `right` alone) come out again when their text is merged."""
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        known = self.pairs[left, right] = self.pieces.merged(left + right) == ([left, right] if left else [right])
        return known

    def tokens(self, text: str) -> list[str]:
        """Tokens of a text whose spaces are written as pieces write them.  A character without a piece is a token."""
        n = len(text)
        # Of the pieces that end at a place of the reversed text the automaton names the longest first.
        first = dict([*self.pieces.longest.iter(text[::-1])][::-1])
        shorter, known, follows = self.pieces.shorter, self.pairs.get, self.follows
        failed, fails = bytearray((n >> 3) + 1), False
        out: list[str] = []
        at, left = 0, ""
        token = first.get(n - 1) or text[:1]
        while at < n:
            end = at + len(token)
            fits = not (fails and failed[end >> 3] >> (end & 7) & 1)
            if fits:
                fits = known((left, token))
                if fits is None:
                    fits = follows(left, token)
            if fits:
                out.append(token)
                at, left = end, token
                token = first.get(n - 1 - at) or text[at : at + 1]
                continue
            token = shorter.get(token)
            if not token:
                failed[at >> 3] |= 1 << (at & 7)
                fails = True
                if not out:
                    raise ValueError("no cut into tokens found")
                token = out.pop()
                at -= len(token)
                left = out[-1] if out else ""
        return out

    def ids(self, tokens: list[str]) -> list[int]:
        out = list(map(self.pieces.id.get, tokens))
        if None in out:
            spelt = ([i] if i is not None else map(self.pieces.byte_id.__getitem__, t.encode()) for i, t in zip(out, tokens, strict=True))
            out = list(chain.from_iterable(spelt))
        return out

    def encode(self, text: str, end: bool = True) -> list[int]:
        """Ids of a whole text."""
        return [int(i) for i in self.decimal(text)[0].split(" ") if i] + [self.pieces.end] * end

    def _part(self, text: str) -> str:
        """Ids of a part of a text, cut again where no piece can reach across."""
        inside = self.pieces.in_pieces
        if inside.issuperset(text):
            ids = self.ids(self.tokens(text))
        else:
            ids, start = [], 0
            for i, c in enumerate(text):
                if c not in inside:
                    ids += self.ids([*self.tokens(text[start:i]), c])
                    start = i + 1
            ids += self.ids(self.tokens(text[start:]))
        back = self._joined(ids)
        if back != text:
            self.changed[text] = back
        return " ".join(map(str, ids))

    def decimal(self, text: str) -> tuple[str, str]:
        """(ids in decimal with spaces between them, decoded text)."""
        if not text:
            return "", ""
        parts = self.pieces.cut.findall(SPACE + text.replace(" ", SPACE))
        if len(self.met) > MAX_PARTS:
            self.met.clear()
            self.changed.clear()
        met, changed, new = self.met, self.changed, set(parts)
        for part in new.difference(met):
            met[part] = self._part(part)
        ids = " ".join(map(met.__getitem__, parts))
        if changed and not new.isdisjoint(changed):
            parts = [changed.get(p, p) for p in parts]
        return ids, "".join(parts).removeprefix(SPACE).replace(SPACE, " ")

    def _joined(self, ids: list[int]) -> str:
        """Pieces side by side; bytes as UTF-8, each byte that is none as U+FFFD."""
        if self.pieces.bytes.isdisjoint(ids):
            return "".join(map(self.pieces.text.__getitem__, ids))
        out, held = [], bytearray()
        for i in ids:
            byte = self.pieces.byte[i]
            if byte is not None:
                held.append(byte)
                continue
            if held:
                out.append(_characters(bytes(held)))
                held.clear()
            out.append(self.pieces.text[i])
        out.append(_characters(bytes(held)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space the encoder put first is taken off, control ids give nothing."""
        return self._joined(ids).removeprefix(SPACE).replace(SPACE, " ")


def _characters(data: bytes) -> str:
    out = []
    while data:
        try:
            return "".join(out) + data.decode()
        except UnicodeDecodeError as wrong:
            out.append(data[: wrong.start].decode() + "�")
            data = data[wrong.start + 1 :]
    return "".join(out)


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def encode_decode(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """Encode every text with an end id, decode the ids, and give both as digests (`texts`: also `ids`, `decoded`).

    `path`: model file, which every worker can open.  Null and empty texts give the end id alone and the digest of
    the empty string; repeated rows give repeated results; columns other than doc_id and text are ignored; an
    empty table gives no rows.  U+2581 counts as a space and comes back as one, as in the library.
    """

    def rows(batch: dict[str, list]) -> dict[str, list]:
        tool = encoder(path)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for text in batch["text"]:
            ids, decoded = tool.decimal(text)
            ids = f"{ids} {tool.pieces.end}".lstrip()
            out["n_tokens"].append(ids.count(" ") + 1)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            out["ids"].append(list(map(int, ids.split(" "))) if texts else None)
            out["decoded"].append(decoded if texts else None)
        return {"doc_id": batch["doc_id"], **out}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(corpus_text(docs), rows, schema + ", ids array<int>, decoded string" * texts)
