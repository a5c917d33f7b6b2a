"""SentencePiece encoding and decoding of whole texts, equal to the public library's for its BPE models.

A merge never reaches over the border of two neighbouring tokens if and only if it doesn't when the two stand alone, so
every prefix of a text has exactly one last token: the one match of the automaton ending there that stands alone and is
compatible with the last token of what precedes it. The table of last tokens is filled from left to right, and the ids are
read off it backwards: linear in the length of a text, however long its words.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from colloquy.llm.common import encoded

#: The visible mark that models write for a space.
SPACE = "▁"
NEVER = float("inf")
#: Words kept with their ids in a Python worker, and pairs kept with their verdicts; beyond that the memory starts afresh.
MOST_WORDS, MOST_PAIRS = 600_000, 2_000_000
#: Kinds of pieces in model files.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, data[at : at + size]
        at += size


class Words(dict):
    """Ids of words as bytes, worked out when a word is first asked for."""

    def __init__(self, find: Callable[[str], bytes]) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> bytes:
        if len(word) > 1_000:  # such words hardly come again
            return self.find(word)
        if len(self) >= MOST_WORDS:
            self.clear()
        found = self[word] = self.find(word)
        return found


class PieceBpe:
    """A BPE model with byte fallback: encode texts to ids, decode ids to text."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            model = list(_fields(file.read()))
        kinds, self.texts, ranks = [], [], []
        trainer = dict(pair for n, part in model if n == 2 for pair in _fields(part))
        normalizer = dict(pair for n, part in model if n == 3 for pair in _fields(part))
        for piece in (dict(_fields(part)) for n, part in model if n == 1):
            self.texts.append(piece[1].decode("utf-8"))
            ranks.append(-struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        plain = normalizer.get(1) == b"identity" and not normalizer.get(2) and not normalizer.get(4, 1) and normalizer.get(5, 1)
        if trainer.get(3) != 2 or not trainer.get(35) or not plain or {USER, UNUSED} & set(kinds):
            raise ValueError(f"{path} is no BPE model with byte fallback and plain text")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        self.unknown_text = trainer[44].decode("utf-8") if 44 in trainer else " ⁇ "
        self.kinds = np.array(kinds)
        self.odd = np.isin(self.kinds, (UNKNOWN, CONTROL))
        self.byte_ids = [self.texts.index(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = dict(zip(self.byte_ids, range(256)))
        self.raw = np.array([bytes([self.byte_of[k]]) if k in self.byte_of else x.replace(SPACE, " ").encode("utf-8") for k, x in enumerate(self.texts)], object)
        self.size, self.code = len(kinds), np.dtype("<u2" if len(kinds) < 65_536 else "<u4")
        self.ranks = {self.texts[k]: ranks[k] for k in range(self.size) if kinds[k] == NORMAL}
        self.lengths = [len(x) for x in self.texts]
        self.matches = ahocorasick.Automaton()
        self.steps: dict[int, list[tuple[float, str, str]]] = {}
        for k, text in enumerate(self.texts):
            if kinds[k] == NORMAL:
                steps, alone = self._merges(text)
                if alone:  # any other piece comes out of no merges
                    self.steps[k] = steps
                    self.matches.add_word(text, k)
        self.matches.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.apart = not any(SPACE in text.lstrip(SPACE) for text in self.ranks)
        self.line_id = self.ids_of_unknown("\n") if not any("\n" in text for text in self.ranks) else None
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.spaced, self.bare = Words(lambda word: self.ids_of_word(SPACE + word)), Words(self.ids_of_word)

    def _merges(self, text: str) -> tuple[list[tuple[float, str, str]], bool]:
        """The merges of a piece that stands alone, each with the symbols at both ends after it; and whether one symbol is left."""
        symbols, steps = list(text), []
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: (self.ranks.get(symbols[i] + symbols[i + 1], NEVER), i))
            rank = self.ranks.get(symbols[best] + symbols[best + 1], NEVER)
            if rank == NEVER:
                return steps, False
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
            steps.append((rank, symbols[0], symbols[-1]))
        return steps, True

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens that stand side by side both last: the merges of either go on in the order of ranks, of equal
        ranks from the left, and none over the border comes first."""
        a, b = self.steps[left], self.steps[right]
        i = j = 0
        edge, begin = self.texts[left][-1], self.texts[right][0]
        while True:
            over = self.ranks.get(edge + begin, NEVER)
            rank_a = a[i][0] if i < len(a) else NEVER
            rank_b = b[j][0] if j < len(b) else NEVER
            if over < rank_a and over <= rank_b:
                return False
            if i < len(a) and rank_a <= rank_b:
                edge = a[i][2]
                i += 1
            elif j < len(b):
                begin = b[j][1]
                j += 1
            else:
                return True

    def last_tokens(self, text: str) -> list[int]:
        """By end, the last token of every prefix; -1 where it is a character that no piece holds."""
        last, lengths, pairs, size = [-1] * (len(text) + 1), self.lengths, self.pairs, self.size
        for end, token in self.matches.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - lengths[token]]
            if before >= 0:
                fits = pairs.get(before * size + token)
                if fits is None:
                    if len(pairs) >= MOST_PAIRS:
                        pairs.clear()
                    fits = pairs[before * size + token] = self.compatible(before, token)
                if not fits:
                    continue
            last[end] = token
        return last

    def ids_of_unknown(self, character: str) -> bytes:
        return np.array([self.byte_ids[b] for b in character.encode("utf-8")], self.code).tobytes()

    def ids_of_word(self, text: str) -> bytes:
        """Ids of a stretch that nothing merges with, backwards from the table."""
        last, at, found = self.last_tokens(text), len(text), []
        while at:
            token = last[at]
            if token >= 0:
                found.append(token)
                at -= self.lengths[token]
            else:
                at -= 1
                found += [self.byte_ids[b] for b in reversed(text[at].encode("utf-8"))]
        return np.array(found[::-1], self.code).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. Stretches that no piece reaches across (words, lines) are met with the ids found before."""
        if not text:
            return np.empty(0, self.code)
        text = self.prefix + text.replace(" ", SPACE)
        if not self.apart:
            return np.frombuffer(self.ids_of_word(text), self.code)
        found = []
        for i, line in enumerate(text.split("\n") if self.line_id else [text]):
            if i:
                found.append(self.line_id)
            words = line.split(SPACE)
            if words[0]:
                found.append(self.bare[words[0]])
            if "" in words[1:]:  # runs of spaces are pieces too
                found += map(self.bare.__getitem__, self.cut.findall(line[len(words[0]) :]))
            else:
                found += map(self.spaced.__getitem__, words[1:])
        return np.frombuffer(b"".join(found), self.code)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: bytes are put together to characters, the first space goes if the model puts one before texts."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and not self.odd[ids].any():
            try:  # the usual case: all bytes together are sound
                text = b"".join(self.raw[ids].tolist()).decode("utf-8")
                return text.removeprefix(" ") if self.prefix and self.kinds[ids[0]] == NORMAL else text
            except UnicodeDecodeError:
                pass
        out, held, started = [], bytearray(), False

        def flush() -> None:
            nonlocal started
            if held:
                out.append(utf8_or_marks(bytes(held)))
                held.clear()
                started = True

        for k in ids.tolist():
            kind = self.kinds[k]
            if kind == BYTE:
                held.append(self.byte_of[k])
                continue
            flush()
            if kind == CONTROL:
                continue
            piece = self.unknown_text if kind == UNKNOWN else self.texts[k]
            if not started and kind == NORMAL and self.prefix:
                piece = piece.removeprefix(SPACE)
            started = True
            out.append(piece.replace(SPACE, " "))
        flush()
        return "".join(out)


def utf8_or_marks(data: bytes) -> str:
    """The text of bytes in UTF-8; each byte that is part of no character is U+FFFD."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out.append("�")
        at += size
    return "".join(out)


@functools.lru_cache(maxsize=4)
def load(path: str) -> PieceBpe:
    """The model at a path that every executor has, once in each Python worker."""
    return PieceBpe(path)


def encode_texts(docs: DataFrame, path: str, column: str = "text", ids: str = "ids", decoded: str | None = None, most_chars: int = 2_000_000) -> DataFrame:
    """Adds ``ids`` (array of int) and, if ``decoded`` names a column, the text that they decode to.

    Whole texts, null as empty (no ids, empty decoded text); repeated rows stay, rows keep their order and other columns,
    an empty table gives an empty one. An existing column of a result's name, whatever its case, is replaced. No shuffle:
    rows stay in their partitions.
    """

    def run(texts: list[str]) -> tuple[list[np.ndarray], list[str] | None]:
        model = load(path)
        found = [model.encode(x) for x in texts]
        return found, [model.decode(x) for x in found] if decoded else None

    return encoded(docs, run, column, ids, decoded, most_chars)
