"""Fast exact front ends to byte-pair tokenizer files.

Both kinds of file that are used here split a text into pre-tokens that never cross a space followed by a character
that is not white space. So a text falls into pieces at such spaces, a piece's ids do not depend on its neighbours, and a
worker can keep the results of pieces. A piece that is not kept yet is split by the file's own pattern and merged by a
compiled byte-pair coder over the file's own ranks; pieces with characters from U+0300 on, or with added tokens, go
through the tokenizer library itself, and so does everything when a file is not laid out as expected.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

from .common import environ_single_thread

environ_single_thread()

#: White space of the tokenizer library below U+0300.
_W = r" \t\n\x0b\x0c\r\x85\xa0"
_BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+"
_WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_W}\p{{L}}\p{{N}}]+"
_high = re.compile("[^\x00-įı-˿]").search  # U+0130 falls into two characters when lower-cased
_odd = re.compile(r" \s| \Z").search
_gap = re.compile(r" (?=\S)")


def _char_bytes() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """ids(piece) for one tokenizer file; words: lower-cased words whose end is marked, white space dropped."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.special = spec["model"], [t["content"] for t in spec["added_tokens"]]
        self.words = model.get("end_of_word_suffix") == "</w>"
        self.split = regex.compile(_WORD_PATTERN if self.words else _BYTE_PATTERN).findall
        self.added = re.compile("|".join(map(re.escape, self.special)) or r"(?!)").search
        byte, ranks, end = _char_bytes(), {}, b"\xff" if self.words else b""
        added = {t["content"] for t in spec["added_tokens"]}
        for token, i in model["vocab"].items():
            if token not in added:
                ends = self.words and token.endswith("</w>")
                ranks[bytes(byte[c] for c in (token[:-4] if ends else token)) + (end if ends else b"")] = i
        base = 512 if self.words else 256
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        in_order = all(model["vocab"].get(a + b) == base + i for i, (a, b) in enumerate(pairs))
        kinds = str(spec.get("normalizer")), str(spec["pre_tokenizer"])
        expected = ("NFC" in kinds[0] and "Lowercase" in kinds[0] and "invert': True" in kinds[1]) if self.words else (kinds[0] == "None" and "'add_prefix_space': False" in kinds[1] and "'use_regex': True" in kinds[1])
        self.end = end
        self.merge = None
        if in_order and expected and all(bytes([b]) in ranks for b in range(256)):
            self.merge = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def slow(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, piece: str) -> list[int]:
        if self.merge is None or not piece.isascii() and _high(piece) or "<" in piece and self.added(piece):
            return self.slow(piece)
        if self.words:
            piece = piece.lower()
            if piece.isalpha():
                return self.merge(piece.encode() + self.end)
        elif piece[1:].isalpha() and piece[0] == " ":
            return self.merge(piece.encode())
        return list(chain.from_iterable(self.merge(p.encode() + self.end) for p in self.split(piece)))

    def pieces(self, text: str) -> list[str]:
        """What a text falls into: the pieces after the first one had a space before them, which is taken off.

        Of the kind that drops white space and case, texts in Latin letters are lower-cased before, unless that
        would make up an added token.
        """
        if not self.words:
            return _gap.split(text) if _odd(text) else text.split(" ")
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split(" ")
        low = text.lower()
        return (text if "<" in text and self.added(low) else low).replace("\n", " ").split(" ")


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    return Coder(path)


class Kept(dict):
    """piece -> value, computed when missing; holds at most ``limit`` entries besides the pinned ones.

    Letters with a comma or a full stop behind them are the letters and the sign, and are not kept; so are two halves with
    a line feed between, if ``after`` has the values of pieces without a space before them.
    """

    def __init__(self, make, pinned: dict | None = None, limit: int = 600_000, after: Kept | None = None) -> None:
        super().__init__(pinned or {})
        self.make, self.pinned, self.limit = make, pinned or {}, limit + len(pinned or {})
        self.after = after
        self.signs = {}

    def __missing__(self, key: str):
        if key[-1:] in (",", ".") and key[:-1].isalpha() and (key.isascii() or not _high(key)):
            sign = self.signs.get(key[-1])
            return self[key[:-1]] + sign if sign is not None else self.make(key)
        if self.after is not None and "\n" in key:
            left, _, right = key.partition("\n")
            if left and right and not left[-1].isspace() and not right[0].isspace():
                return self[left] + self.signs["\n"] + self.after[right]
        if len(self) >= self.limit:
            self.clear()
            self.update(self.pinned)
        value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value
