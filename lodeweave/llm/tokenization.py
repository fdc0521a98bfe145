"""Memoised use of the ``tokenizers`` library.

Both supported families (byte-level BPE, and word-end BPE that drops white space) first cut a text into
units and then merge each unit on its own. Here the cut is made by a regular expression and each distinct
unit is merged once per worker by the library's BPE model. That holds for texts of printable ASCII, Latin-1
letters, blanks and line ends; any other text, and any other tokenizer, goes through the library's whole
encoder, and so does a text that holds the string of an added token (such as the end-of-text mark). The ids are those of
``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``, which reads such a string as that token.

``encode_column`` does a whole Arrow column: Arrow's kernels cut the plain texts at blanks and line ends and number the
distinct pieces, Python sees each distinct piece of a group of texts once, and numpy lays out the ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Texts that the direct way may take: printable ASCII, Latin-1 letters, blanks, line ends.
_PLAIN = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*\Z")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_UNITS = re.compile(rf" ?[{_LETTER}]+|{_CONTRACTIONS}| ?[0-9]+| ?[^ \n{_LETTER}0-9]+|[ \n]+(?![^ \n])|[ \n]+")
_END_UNITS = re.compile(rf"[{_LETTER}]+|{_CONTRACTIONS}|[0-9]|[^ \n{_LETTER}0-9]+")
#: Parts joined pieces; its id, that of no token.
_PART, _PART_ID = "\r", 2**32 - 1
#: The same as patterns of Arrow's kernels.
_ARROW_PLAIN, _ARROW_RUN = r"\A[ \n!-~À-ÖØ-öø-ÿ]*\z", r"[ \n][ \n]"
#: Bytes of texts that are encoded together, about.
_GROUP = 4_000_000


def _byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Bank:
    """The ids of numbered strings, in one array. Beyond `most` strings, those stay that were asked for most."""

    def __init__(self, most: int):
        self.most = most
        self.bank, self.starts, self.lengths, self.asked = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, np.cumsum(lengths) - lengths + len(self.bank)))
        self.bank, self.lengths = np.concatenate((self.bank, flat)), np.concatenate((self.lengths, lengths))
        self.asked = np.concatenate((self.asked, np.zeros(len(lengths), np.int64)))

    def _thin(self) -> np.ndarray:
        """Forget the least asked for; the numbers of those that stay."""
        floor = 2
        while (self.asked >= floor).sum() > self.most // 2:
            floor *= 2
        kept = np.flatnonzero(self.asked >= floor)
        self.bank, self.lengths = self.ids(kept)
        self.starts, self.asked = np.cumsum(self.lengths) - self.lengths, self.asked[kept]
        return kept

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these strings one after the other, and how many each has."""
        n = self.lengths[numbers]
        upto = np.cumsum(n)
        places = np.repeat(self.starts[numbers] - upto + n, n)
        places += np.arange(len(places))
        return self.bank[places], n


class _Units(_Bank):
    """Units with the ids that the model merges them to."""

    def __init__(self, model, most: int):
        super().__init__(most)
        self.model, self.letters = model, _byte_letters()
        self.number: dict[str, int] = {}

    def _merge(self, names: list[str]) -> None:
        mapped = _PART.join(names).encode().decode("latin-1").translate(self.letters).split(self.letters[ord(_PART)])
        merged = list(map(self.model.tokenize, mapped))
        self._append(np.array([t.id for tokens in merged for t in tokens], "<u4"), np.fromiter(map(len, merged), np.int64, len(merged)))

    def numbers(self, cut: list[str]) -> np.ndarray:
        """The number of each unit, that of _PART included; new ones are merged."""
        if len(self.number) > self.most:
            kept, names = self._thin(), list(self.number)
            self.number = {names[i]: k for k, i in enumerate(kept.tolist())}
        found = np.fromiter(map(self.number.get, cut, repeat(-1)), np.int64, len(cut))
        new = np.flatnonzero(found < 0)
        if len(new):
            asked = [cut[i] for i in new.tolist()]
            names = [n for n in dict.fromkeys(asked) if n != _PART]
            if _PART not in self.number and len(names) < len(set(asked)):
                self.number[_PART] = len(self.number)
                self._append(np.array([_PART_ID], "<u4"), np.ones(1, np.int64))
            if names:
                self.number.update(zip(names, range(len(self.number), len(self.number) + len(names)), strict=True))
                self._merge(names)
            found[new] = np.fromiter(map(self.number.__getitem__, asked), np.int64, len(asked))
        self.asked += np.bincount(found, minlength=len(self.asked))
        return found


class _Pieces(_Bank):
    """Stretches between single blanks or line ends, looked up by Arrow. New ones are joined by a character that no plain
    text holds, cut into units all at once, and parted again by the id that stands for that character."""

    def __init__(self, units: _Units, pattern: re.Pattern, most: int):
        super().__init__(most)
        self.units = units
        self.find = re.compile(pattern.pattern.replace(r"[^ \n", rf"[^ \n{_PART}") + "|" + _PART).findall
        self.names = pa.array([], pa.string())

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """The number of each piece."""
        if len(self.names) > self.most:
            self.names = self.names.take(pa.array(self._thin()))
        places = pc.index_in(pieces, value_set=self.names)
        found = places.fill_null(-1).to_numpy().astype(np.int64)
        if places.null_count:
            new = pieces.filter(places.is_null()).dictionary_encode()
            found[found < 0] = new.indices.to_numpy() + len(self.names)
            flat, _ = self.units.ids(self.units.numbers(self.find(_PART.join(new.dictionary.to_pylist()))))
            parts = np.flatnonzero(flat == _PART_ID)
            starts, ends = np.concatenate(([0], parts + 1)), np.append(parts, len(flat))
            self._append(flat[flat != _PART_ID], ends - starts)
            self.names = pa.concat_arrays([self.names, new.dictionary])
        self.asked += np.bincount(found, minlength=len(self.asked))
        return found


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids. ``most``: units, and pieces, kept before a memory is thinned out."""

    def __init__(self, path: str, most: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = json.dumps(spec.get("pre_tokenizer") or {})
        norm = json.dumps(spec.get("normalizer") or {})
        self.lower = bool(spec["model"].get("end_of_word_suffix")) and '"Lowercase"' in norm
        byte_level = spec.get("normalizer") is None and '"type": "ByteLevel"' in pre and '"add_prefix_space": false' in pre and '"use_regex": true' in pre
        self.direct = self.lower or byte_level
        pattern = _END_UNITS if self.lower else _BYTE_UNITS
        self.find = pattern.findall
        # strings that the library takes out before it cuts; compared without case where the vocabulary is
        added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE if self.lower else 0).search
        self.arrow_added = added
        self.units = _Units(self.tokenizer.model, most)
        self.pieces = _Pieces(self.units, pattern, most)

    def whole(self, text: str) -> bytes:
        """The library's own encoder."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of one text, four bytes each."""
        if not (self.direct and _PLAIN.match(text)) or self.added(text):
            return self.whole(text)
        ids, _ = self.units.ids(self.units.numbers(self.find(text.lower() if self.lower else text)))
        return ids.tobytes()

    def encoded(self, column: pa.Array, end: bytes) -> Iterator[bytes]:
        """Each text's ids and then `end`, as bytes."""
        for ids, counts in self.encode_column(column):
            raw, upto = ids.tobytes(), 0
            for n in counts.tolist():
                yield raw[upto : upto + 4 * n] + end
                upto += 4 * n

    def encode_column(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For groups of consecutive texts (no nulls): ids one after the other, and the number of ids of each text."""
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _GROUP)))
            yield self._group(column.slice(at, end - at))
            at = end

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        direct = np.zeros(len(texts), bool)
        if self.direct:
            plain = pc.match_substring_regex(texts, _ARROW_PLAIN)
            if not self.lower:  # the cut between blanks depends on what follows them
                plain = pc.and_not(plain, pc.match_substring_regex(texts, _ARROW_RUN))
            for content in self.arrow_added:
                plain = pc.and_not(plain, pc.match_substring(texts, content, ignore_case=self.lower))
            direct = plain.to_numpy(zero_copy_only=False)
        if direct.all():
            return self._direct(texts)
        rest = iter([np.frombuffer(self.encode(t), "<u4") for t in texts.filter(pa.array(~direct)).to_pylist()])
        ids, n = self._direct(texts.filter(pa.array(direct)))
        own = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
        parts = [next(own) if d else next(rest) for d in direct.tolist()]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _direct(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if self.lower:
            lists = pc.split_pattern(pc.replace_substring(pc.utf8_lower(texts), "\n", " "), " ")
        else:
            lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01\n\x01"), "\x01")
        ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        ids, n = self.pieces.ids(self.pieces.numbers(lists.flatten()))
        return ids, np.diff(np.concatenate(([0], np.cumsum(n)))[ends])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file; what it has merged serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
