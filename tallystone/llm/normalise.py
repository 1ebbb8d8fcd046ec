"""Longest-prefix normalisation through a sentencepiece model's compiled character map, with the source offset of every byte."""

from __future__ import annotations

import struct

import numpy as np

SPACE = "▁".encode()


class CharacterMap:
    """The compiled map: a double-array trie of source strings whose values are offsets of zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = blob[4 + size :] if size else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that is a prefix of text[at:]."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        place = (unit >> 10) << ((unit & 0x200) >> 6)
        for end in range(at, len(text)):
            place ^= text[end]
            if place >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != text[end]:  # the label, which no leaf has
                break
            place ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:  # a key ends here
                start = units[place] & 0x7FFFFFFF
                found = end - at + 1, self.replacements[start : self.replacements.index(b"\0", start)]
        return found


class Normaliser:
    """normalised bytes, and for each of them and the end the offset in the source where it comes from."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces

    def _steps(self, text: bytes):
        """(place, length in the source, replacement) by longest prefix, else one character as it is."""
        at = 0
        while at < len(text):
            found = self.map.longest(text, at)
            if found is None:
                size = 1 if text[at] < 0x80 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
                found = size, text[at : at + size]
            yield at, *found
            at += found[0]

    def _mapped(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Bytes after the map, and each one's offset: a replaced prefix has that of its begin, any other byte its own. An empty map leaves all bytes."""
        if not self.map.units and not self.squeeze:
            return np.frombuffer(text, "u1"), np.arange(len(text), dtype="i8")
        steps = list(self._steps(text))
        if self.squeeze:
            while steps and steps[0][2] in (b" ", b""):
                steps.pop(0)
        out, source, was_space = bytearray(), [], self.squeeze
        for at, size, new in steps:
            replaced = new != text[at : at + size]
            drop = len(new) - len(new.lstrip(b" ")) if was_space else 0
            out += new[drop:]
            source += [at] * (len(new) - drop) if replaced else range(at + drop, at + size)
            if new[drop:]:
                was_space = self.squeeze and new.endswith(b" ")
        return np.frombuffer(bytes(out), "u1"), np.array(source, "i8")

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        line, source = self._mapped(text)
        end = len(text)
        if self.squeeze:
            kept = len(line.tobytes().rstrip(b" "))
            end = int(source[kept]) if kept < len(line) else end
            line, source = line[:kept], source[:kept]
        if not len(line):
            return b"", np.zeros(1, "i8")
        # a space is written as the three bytes of SPACE, all from where it stands
        sizes = np.where(line == 0x20, len(SPACE), 1)
        source = np.repeat(source, sizes)
        out = line.tobytes().replace(b" ", SPACE)
        if self.prefix:
            out, source = SPACE + out, np.concatenate([np.repeat(source[:1], len(SPACE)), source])
        return out, np.append(source, end)
