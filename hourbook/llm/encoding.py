"""Token ids of whole texts with a tokenizer file, for use inside tasks.

Most of a tokenizer's time goes into words it has met before.  The tokenizers
here never join characters across certain places, so a text can be cut there,
each distinct piece encoded once by the library, and the ids of a text put
together from its pieces:

``lead``: byte-level BPE whose pre-tokenizer puts one space in front of the next
word.  Where every space stands alone between other characters, a token starts
at each space; where no white space stands beside other white space, a line
feed is a token of its own.  Texts that don't meet the first are encoded whole.

``drop``: pre-tokenizers that drop white space and lower-case.  Texts are cut at
spaces and line feeds.

Both also cut before a full stop or comma that follows a letter or digit and
ends a piece, if that holds for all of them in the text, and between a Latin
letter and marks such as ``!`` or ``#``.  Any other value of ``cut`` encodes whole
texts only.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_PIECES = 400_000
CUT = "\x01"


def worker_encoder(path: str, cut: str | None, end_id: int, as_text: bool = False) -> Encoder:
    """One encoder per worker process, so later tasks find its pieces."""
    state = sys.modules.setdefault("_hourbook_worker", types.ModuleType("_hourbook_worker")).__dict__
    key = (path, cut, end_id, as_text)
    if key not in state:
        state[key] = Encoder(*key)
    return state[key]


def slices(batch: pa.RecordBatch, text: int, rows: int = 1500, n_bytes: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of a bounded number of rows and of bytes in column
    ``text`` (a longer text: a slice of its own)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(max(int(np.searchsorted(ends, before + n_bytes, "right")), at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end


def words(ids: Sequence[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _dealt(pieces: list[str], ids: list[int], ends: np.ndarray) -> list[tuple[str, bytes]]:
    """Each piece with its ids, given the place where each one's ids end."""
    raw, ends = words(ids), (ends * 4).tolist()
    return [(piece, raw[a:b]) for piece, a, b in zip(pieces, [0, *ends], ends)]


class Encoder:
    def __init__(self, path: str, cut: str | None, end_id: int, as_text: bool = False):
        """``as_text``: special tokens' strings inside texts are plain text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = as_text
        # For pieces of letters alone, which the patterns would find to be one word
        # each: many in one text, told apart by the separator.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        one_word = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(CUT, "removed"), one_word])
        # Bytes that a token stands for: a character each, but for the mark of a word's end.
        vocabulary, ending = self.letters.get_vocab(), getattr(self.letters.model, "end_of_word_suffix", None) or ""
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token.removesuffix(ending))
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut, self.end = cut, words([end_id])
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.beside_space = re.compile(r" \s|\s ")
        self.beside = re.compile(r"\s\s")
        # A full stop or comma after anything but a (Latin) letter or ASCII digit.
        self.odd_stop = re.compile(r"[^A-Za-z0-9À-ÖØ-öø-ɏ][.,]")
        # One word whatever stands beside it; ``drop`` leaves only letters that lower case keeps.
        letters = r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+" if cut == "lead" else r"[a-zß-öø-ÿ]+"
        self.latin_word = re.compile(letters).fullmatch
        self.beyond_latin = re.compile(r"[^\x00-ɏ]")
        # Marks that make many forms of a word; a token ends before any of them.
        self.marks = re.compile(r"[!#$%&*]")
        self.before_mark = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[!#$%&*,.])")

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [words(e.ids) for e in found]

    def _each(self, pieces: list[str]) -> list[tuple[str, bytes]]:
        """(piece, its ids), by one call for all: a token's word id is its piece."""
        if not pieces or any(s in "\0".join(pieces).lower() for s in self.special):
            return list(zip(pieces, self._whole(pieces)))
        plain = [p for p in pieces if self.latin_word(p)]
        rest = list(set(pieces).difference(plain))
        out = []
        if plain:
            # The fast call names no words: a piece ends where its bytes do.
            (found,) = self.letters.encode_batch_fast([CUT.join(plain)], add_special_tokens=False)
            lengths = np.cumsum([len(p.encode()) for p in plain])
            out += _dealt(plain, found.ids, np.searchsorted(np.cumsum(self.n_bytes[found.ids]), lengths, "right"))
        if rest:
            found = self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
            out += _dealt(rest, found.ids, np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(rest)), "right"))
        return out

    def _separated(self, text: str) -> str | None:
        """The text with a separator between its pieces; None: not to be cut."""
        if CUT in text or self.cut not in ("lead", "drop"):
            return None
        if self.marks.search(text) and not any(s in text.lower() for s in self.special):
            text = self.before_mark.sub(" " if self.cut == "drop" else CUT, text)
        if self.cut == "drop":
            # Lower case is what the tokenizer makes of these characters too.
            if not self.beyond_latin.search(text):
                lower = text.lower()
                if not any(s in lower for s in self.special):
                    text = lower
            text = text.replace("\n", " ")
            if not self.odd_stop.search(text):
                text = text.replace(". ", " . ").replace(", ", " , ")
            return text.replace(" ", CUT)
        if self.beside.search(text):
            return None if self.beside_space.search(text) else text.replace(" ", CUT + " ")
        text = text.replace(" ", CUT + " ").replace("\n", f"{CUT}\n{CUT}")
        if not self.odd_stop.search(text):
            text = text.replace("." + CUT, f"{CUT}.{CUT}").replace("," + CUT, f"{CUT},{CUT}")
        return text

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, the end id last."""
        separated = [self._separated(t or "") for t in texts]
        cut = iter(self._from_pieces([s for s in separated if s is not None]))
        whole = iter(self._whole([t or "" for t, s in zip(texts, separated) if s is None]))
        return [next(whole if s is None else cut) + self.end for s in separated]

    def _from_pieces(self, separated: list[str]) -> list[bytes]:
        """Each distinct piece of the batch is looked up once; the texts' ids
        are then gathered from the pieces' ids by place."""
        if not separated:
            return []
        pieces = pc.split_pattern(pa.array(separated, pa.large_string()), CUT)
        coded = pieces.values.dictionary_encode()
        ids = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.array([len(i) for i in ids], np.int64) // 4
        place, block = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        flat = block[np.repeat(place[which] - ends + n, n) + np.arange(n.sum())].tobytes()
        bounds = (np.concatenate([[0], ends])[pieces.offsets.to_numpy()] * 4).tolist()
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def _known(self, pieces: list[str]) -> list[bytes]:
        if len(self.young) > CACHED_PIECES:
            self.old, self.young = self.young, {"": b""}
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for piece in [pieces[i] for i in gaps]:
            if (ids := old.get(piece)) is not None:
                young[piece] = ids
            else:
                new.append(piece)
        young.update(self._each(new))
        for i in gaps:
            found[i] = young[pieces[i]]
        return found
