"""Subword ids of whole texts in bounded memory.

Texts are cut into parts of about ``PART_BYTES`` at places where neither
vocabulary has a token across (a blank between two ASCII letters), parts into
words, and every distinct word is encoded once per task. A vocabulary file
whose settings would let words influence each other is not cut: its texts are
encoded whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from flowtrace.llm.arrays import binary_array
from flowtrace.llm.byte_bpe import Classes, pre_tokens
from flowtrace.llm.lexicon import Lexicon
from flowtrace.llm.token_store import byte_letters

#: Bytes worked through at once (beyond one word).
PART_BYTES = 1 << 20


def parts(data: np.ndarray, offsets: np.ndarray, limit: int | None = None):
    """(first text, data, offsets) of consecutive parts. Texts that fit stay
    whole; longer ones are cut before a blank between two ASCII letters."""
    limit = limit or PART_BYTES
    allowed = [offsets]
    for t in np.flatnonzero(np.diff(offsets) > limit).tolist():
        text = data[offsets[t]:offsets[t + 1]]
        letter = ((text | 0x20) >= 97) & ((text | 0x20) <= 122)
        allowed.append(offsets[t] + 1 + np.flatnonzero((text[1:-1] == 0x20) & letter[:-2] & letter[2:]))
    places = np.unique(np.concatenate(allowed))
    a, end = 0, int(offsets[-1])
    while a < end:
        k = int(np.searchsorted(places, a + limit, "right")) - 1
        if places[k] <= a:
            k += 1
        b = int(places[k])
        first = int(np.searchsorted(offsets, a, "right")) - 1
        last = int(np.searchsorted(offsets, b, "left"))
        yield first, data[a:b], np.concatenate([[a], offsets[first + 1:last], [b]]) - a
        a = b


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    coded = binary_array(data, np.append(starts, len(data))).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _replace(ids, counts, texts, encoded):
    """``ids`` with those of the given texts replaced."""
    split = np.split(ids, np.cumsum(counts)[:-1])
    for t, new in zip(texts, encoded):
        split[t] = np.array(new, np.uint32)
    return np.concatenate(split), np.array([len(s) for s in split], np.int64)


class ByteLevelBpe:
    """A byte-level BPE file of the tokenizers library.

    ``specials``: whether strings of special tokens in a text become those
    tokens, as the library does unless told otherwise.
    """

    def __init__(self, path: str, specials: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added, model, cut = spec["added_tokens"], spec["model"], spec["pre_tokenizer"] or {}
        self.specials = [t["content"].encode() for t in added if specials]
        # Words are independent under the plain byte-level pattern only.
        self.by_word = (
            spec["normalizer"] is None and spec.get("post_processor") is None and model["type"] == "BPE"
            and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
            and not cut.get("add_prefix_space", True) and not model.get("dropout")
            and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
            and not model.get("end_of_word_suffix")
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] for t in added)
            and all(t["special"] for t in added))
        letters = byte_letters()
        self.shown = "".join(letters[b] for b in range(256))
        back = {c: b for b, c in letters.items()}
        entries = {i: bytes(back[c] for c in w) for w, i in model["vocab"].items()} \
            | {t["id"]: t["content"].encode() for t in added}
        #: Bytes of every id (empty where the file has none).
        self.entries = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.classes, self.lexicon = Classes(), Lexicon(self._encode)
        self.changed = np.zeros(0x110000, np.uint8)

    def _encode(self, words: list[bytes]):
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(w.decode("latin-1").translate(self.shown))] for w in words]

    def _whole(self, texts: list[bytes]):
        return [e.ids for e in self.tokenizer.encode_batch_fast(
            [t.decode() for t in texts], add_special_tokens=False)]

    def _unsure(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with characters whose class depends on the edition of the
        Unicode tables, or with a special token's string."""
        import unicodedata

        odd = np.zeros(len(offsets) - 1, bool)
        text = data.tobytes()
        for special in self.specials:
            if special in text:
                odd |= np.array([special in text[a:b] for a, b in zip(offsets[:-1], offsets[1:])])
        if (data >= 0xC8).any():  # U+0200 and up
            points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
            high = np.flatnonzero(points >= 0x200)
            known = self.changed[points[high]]
            if not known.all():
                for p in np.unique(points[high][known == 0]).tolist():
                    now, then = (u.category(chr(p))[0] for u in (unicodedata, unicodedata.ucd_3_2_0))
                    kinds = [{"L": 1, "N": 2, "Z": 3}.get(c, 4) for c in (now, then)]
                    self.changed[p] = 1 + (kinds[0] != kinds[1])
                known = self.changed[points[high]]
            if (known == 2).any():
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                at = lead[high[known == 2]]
                odd[np.searchsorted(offsets, at, "right") - 1] = True
        return odd

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        odd = self._unsure(data, offsets) if self.by_word else np.ones(n, bool)
        if odd.all():
            ids, counts = np.zeros(0, np.uint32), np.zeros(n, np.int64)
        else:
            starts, before = pre_tokens(data, offsets, self.classes)
            ids, sizes = self.lexicon.ids(*_words(data, starts))
            counts = np.diff(np.append(0, np.cumsum(sizes))[before])
        if odd.any():
            texts = np.flatnonzero(odd).tolist()
            raw = [data[offsets[t]:offsets[t + 1]].tobytes() for t in texts]
            ids, counts = _replace(ids, counts, texts, self._whole(raw))
        return ids, counts


class PieceModel:
    """A BPE model file of the sentencepiece library that writes blanks as
    U+2581 and adds one at the start. Texts are given with that blank."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Bytes of every id; U+2581 is a blank, <0xHH> a byte.
        self.entries = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else
            b"" if self.model.is_control(i) or self.model.is_unknown(i) else
            p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        blank = self.model.piece_to_id("▁")
        # Words are independent if no piece goes on into the next word and
        # white space stays as it is.
        self.by_word = not self.model.is_unknown(blank) and not any(
            " " in e.lstrip(b" ").decode("utf-8", "replace") for e in self.entries) and all(
            b"".join(self.entries[i] for i in self.model.encode(t)) == b" " + t.encode()
            for t in (" ", "a  b ", " \ta\n"))
        self.blank, self.lexicon = [blank], Lexicon(self._encode)

    def _encode(self, words: list[bytes]):
        words = [w.decode()[1:] for w in words]
        return [ids if w else self.blank for w, ids in zip(words, self.model.encode(words, num_threads=1))]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`ByteLevelBpe.ids`, for texts that start with a blank."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if not self.by_word:
            whole = [self.model.encode(data[a + 1:b].tobytes().decode()) if b > a else []
                     for a, b in zip(offsets[:-1], offsets[1:])]
            return np.array([i for ids in whole for i in ids], np.uint32), np.array([len(w) for w in whole], np.int64)
        blank = data == 0x20
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        starts[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(starts)
        ids, sizes = self.lexicon.ids(*_words(data, starts))
        return ids, np.diff(np.append(0, np.cumsum(sizes))[np.searchsorted(starts, offsets, "left")])
