"""What a sentencepiece model says of its normaliser, and normalisation that keeps offsets."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

MARK = "▁"
#: Kinds of pieces in a model file: normal 1, unknown 2, control 3, user-defined 4, unused 5, byte 6.
BYTE, USER_DEFINED = 6, 4


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message, as its public wire format has them."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        elif key & 7 == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def read_charmap(blob: bytes) -> dict[bytes, bytes]:
    """The rules of a compiled character map: source bytes to replacement bytes.

    The blob holds the size of a double-array trie, the trie in 32-bit units, and zero-ended
    replacements; a walk over all paths lists the rules.
    """
    if len(blob) < 4:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, "<u4", size // 4, 4)
    ends = blob[4 + size :]
    rules: dict[bytes, bytes] = {}

    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    todo = [(0 ^ offset(int(units[0])), b"")]
    while todo:
        at, key = todo.pop()
        for c in range(1, 256):
            if (child := at ^ c) < len(units):
                unit = int(units[child])
                if unit & (1 << 31 | 0xFF) != c:
                    continue
                base = child ^ offset(unit)
                if unit >> 8 & 1:
                    start = int(units[base]) & 0x7FFFFFFF
                    rules[key + bytes([c])] = ends[start : ends.index(b"\0", start)]
                todo.append((base, key + bytes([c])))
    return rules


@dataclass
class Model:
    """Pieces and normaliser settings of a model file."""

    pieces: list[str] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    rules: dict[bytes, bytes] = field(default_factory=dict)
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False

    def splits_at_blanks(self) -> bool:
        inner = any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds) if k == 1)
        return not (inner or self.rules or self.squeeze or self.suffix or USER_DEFINED in self.kinds) and self.dummy_prefix and self.escape

    def __post_init__(self) -> None:
        self._tree: dict | None = None

    def _longest(self, b: bytes, i: int) -> tuple[int, bytes]:
        """Length and replacement of the longest rule that starts at ``i``; 0 if there is none."""
        if self._tree is None:
            self._tree = {}
            for key, value in self.rules.items():
                node = self._tree
                for c in key:
                    node = node.setdefault(c, {})
                node[-1] = value
        node, best = self._tree, (0, b"")
        for j in range(i, len(b)):
            node = node.get(b[j])
            if node is None:
                break
            if -1 in node:
                best = (j + 1 - i, node[-1])
        return best

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and the end) its place in the text's bytes.

        At each place the longest rule applies, else the character stays; blanks are squeezed at
        both ends and inside if the model says so, then a mark stands for each, after a dummy one.
        """
        b = text.encode()
        if not self.rules and not self.squeeze:
            return self._plain(b)
        parts: list[tuple[bytes, int, int]] = []
        i = 0
        while i < len(b):
            n, value = self._longest(b, i)
            if not n:
                n = 1 if b[i] < 0x80 else 2 if b[i] < 0xE0 else 3 if b[i] < 0xF0 else 4
                value = b[i : i + n]
            parts.append((value, i, i + n))
            i += n
        units: list[tuple[bytes, int, int]] = []
        for value, s, e in parts:
            units += [(bytes([c]), s, e) for c in value]
        if self.squeeze:
            kept: list[tuple[bytes, int, int]] = []
            for u in units:
                if u[0] == b" " and (not kept or kept[-1][0] == b" "):
                    continue
                kept.append(u)
            while kept and kept[-1][0] == b" ":
                kept.pop()
            units = kept
        mark = MARK.encode() if self.escape else b" "
        out, at = bytearray(), []
        if units and self.dummy_prefix and not self.suffix:
            out += mark
            at += [units[0][1]] * len(mark)
        for c, s, _ in units:
            c = mark if c == b" " else c
            out += c
            at += [s] * len(c)
        if units and self.dummy_prefix and self.suffix:
            out += mark
            at += [units[-1][2]] * len(mark)
        return bytes(out), np.array([*at, units[-1][2] if units else len(b)], np.int64)

    def _plain(self, b: bytes) -> tuple[bytes, np.ndarray]:
        """No rules: only blanks change, so places follow from running sums."""
        if not b:
            return b"", np.zeros(1, np.int64)
        mark = MARK.encode() if self.escape else b" "
        raw = np.frombuffer(b, np.uint8)
        width = np.where(raw == 32, len(mark), 1)
        at = np.repeat(np.arange(len(raw), dtype=np.int64), width)
        lead = np.zeros(len(mark) if self.dummy_prefix and not self.suffix else 0, np.int64)
        tail = np.full(len(mark) if self.dummy_prefix and self.suffix else 0, len(raw), np.int64)
        text = b.replace(b" ", mark)
        return (mark if len(lead) else b"") + text + (mark if len(tail) else b""), np.concatenate([lead, at, tail, [len(raw)]])


def read_model(blob: bytes) -> Model:
    """Fields of the public model format: 1 pieces (1 text, 3 kind), 3 normaliser (2 character map,
    3 dummy prefix, 4 squeeze blanks, 5 escape blanks), 2 trainer (24 blanks as suffix)."""
    m = Model()
    for number, value in _fields(blob):
        if number == 1:
            piece = dict(_fields(value))
            m.pieces.append(piece.get(1, b"").decode())
            m.kinds.append(piece.get(3, 1))
        elif number == 2:
            m.suffix = bool(dict(_fields(value)).get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            m.rules = read_charmap(spec.get(2, b""))
            m.dummy_prefix, m.squeeze, m.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return m
