"""Token ids of many texts, with stretches of text that come again encoded once.

Both kinds of vocabulary here split a text before a single space that stands between two
characters that are not white space, whatever is around: no token reaches over such a place and
none depends on what lies beyond it. So a text is cut there, each stretch goes to the tokenizer
once in a worker, and ids are put together by look-up. The result is that of the whole text.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A stretch that no space precedes starts with this in the memo; no text can hold it.
HEAD = "\ud800"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"
_ODD = rf"^ | $| {_WHITE}|{_WHITE} "  # texts with a space that is no cut
MARK = "▁"
GROUP = 2_000  # stretches that the tokenizer gets as one text

Encode = Callable[[list[str]], list[list[int]]]


def vocabulary_path(name: str) -> str:
    """A file of the installed public tokenizers, or ``name`` itself if it is a path."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Ids of stretches that came twice; forgotten as a whole beyond KEEP of them or KEEP_CHARS.

    A stretch is kept less the space in front; one without such a space has HEAD in front. One
    that comes for the first time only leaves a mark under its hash, so words that never come
    again take no memory; a shared mark only means that a word is kept early.
    ``encode_all`` gives the ids of whole texts, ``widths`` how many bytes of text an id spells.
    """

    KEEP, KEEP_CHARS, MARKS = 700_000, 9_000_000, 1 << 22

    def __init__(self, encode_all: Encode, widths: np.ndarray):
        self.encode_all, self.widths = encode_all, widths
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.seen = bytearray(self.MARKS)
        self.chars = 0
        self.flat, self.first = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: pa.Array, lead: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has.

        With ``lead`` each text counts with a space in front. Null texts have no ids, nor have
        empty ones.
        """
        if len(self.known) > self.KEEP or self.chars > self.KEEP_CHARS:
            self.clear()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        even = ~pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        parts_of = np.zeros(len(texts), np.int64)
        parts = pc.split_pattern(texts.filter(pa.array(even)), " ")
        parts_of[even] = parts.value_lengths().to_numpy()
        odd = [
            _CUT.split(" " + t if lead else t)
            for t in texts.filter(pa.array(~even)).to_pylist()
        ]
        parts_of[~even] = list(map(len, odd))
        if lead:
            parts_of[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = 0
        ends = np.cumsum(parts_of)
        at = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        head = np.zeros(len(at), bool)
        head[(ends - parts_of)[parts_of > 0]] = True
        of_even = np.repeat(even, parts_of)
        flat = parts.flatten()
        if lead:
            flat = flat.filter(pc.not_equal(flat, ""))  # what an empty text is split into
            inner, first = of_even, []
        else:
            heads = pa.array(head[of_even])
            first = [HEAD + t for t in flat.filter(heads).to_pylist()]
            flat, inner = flat.filter(pc.invert(heads)), of_even & ~head
        coded = flat.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        at[inner] = coded.indices.to_numpy()
        at[of_even & ~inner] = len(keys) + np.arange(len(first))
        keys += first
        rest = [HEAD * (not i) + p for cut in odd for i, p in enumerate(cut)]
        at[~of_even] = len(keys) + np.arange(len(rest))
        keys += rest
        place, ids, begins = self.look_up(keys, np.bincount(at, minlength=len(keys)))
        at = place[at]
        begin = begins[at]
        size = begins[at + 1] - begin
        stop = np.cumsum(size)
        out = ids[np.repeat(begin - stop + size, size) + np.arange(int(size.sum()))]
        return out, np.diff(np.concatenate([[0], stop])[ends], prepend=0)

    def look_up(
        self, keys: list[str], times: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of stretches that come ``times`` in a pass, and the ids behind the places."""
        known, seen, marks = self.known, self.seen, self.MARKS
        place = np.fromiter(map(known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if not len(new):
            return place, self.flat, self.first
        hashes = [hash(keys[i]) % marks for i in new.tolist()]
        again = np.fromiter((seen[h] for h in hashes), bool, len(new)) | (times[new] > 1)
        for h in hashes:
            seen[h] = 1
        new = np.concatenate([new[again], new[~again]])  # those to be kept come first
        kept = int(again.sum())
        fresh = [keys[i] for i in new.tolist()]
        found, sizes = self.encode_stretches(fresh)
        place[new] = len(self.first) - 1 + np.arange(len(new))
        ids = np.concatenate([self.flat, found])
        first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        for k, i in zip(fresh[:kept], place[new[:kept]].tolist(), strict=True):
            known[k] = i
            self.chars += len(k)
        self.first = first[: len(self.first) + kept].copy()
        self.flat = ids[: self.first[-1]].copy()
        return place, ids, first

    def encode_stretches(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new stretches end to end, and how many each has.

        Stretches with a space in front make one text in groups, which is cut again where their
        bytes end; a group whose tokens do not end there, and stretches with HEAD, go one by one.
        """
        ids: list[np.ndarray] = []
        sizes = np.zeros(len(keys), np.int64)
        if not keys:
            return np.empty(0, np.int32), sizes
        lo = 0
        while lo < len(keys):
            hi = min(lo + GROUP, len(keys))
            group = keys[lo:hi]
            joined = None
            if not any(k[0:1] == HEAD for k in group):
                joined = self.encode_joined(group)
            if joined is None:
                texts = [k[1:] if k[0:1] == HEAD else " " + k for k in group]
                found = self.encode_all(texts)
                n = np.fromiter(map(len, found), np.int64, len(found))
                joined = np.array([i for f in found for i in f], np.int32), n
            ids.append(joined[0])
            sizes[lo:hi] = joined[1]
            lo = hi
        return np.concatenate(ids), sizes

    def encode_joined(self, group: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of ``" " + " ".join(group)`` cut by stretch, or None if they do not cut there."""
        (found,) = self.encode_all([" " + " ".join(group)])
        ids = np.array(found, np.int32)
        spelled = np.cumsum(self.widths[ids])
        stops = np.cumsum([len(k.encode()) + 1 for k in group])
        last = np.searchsorted(spelled, stops)
        if not len(ids) or last[-1] != len(ids) - 1 or (spelled[last] != stops).any():
            return None
        return ids, np.diff(last, prepend=-1)


@functools.cache
def byte_level(name: str, plain_specials: bool = False) -> Memo:
    """A worker's memo over a byte-level vocabulary of the tokenizers library.

    With ``plain_specials`` the strings of special tokens are plain text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary_path(name))
    model.encode_special_tokens = plain_specials
    widths = np.zeros(model.get_vocab_size(), np.int64)
    for token, i in model.get_vocab().items():
        widths[i] = len(token)  # one character of a token stands for one byte
    return Memo(
        lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)],
        widths,
    )


@functools.cache
def piece_level(name: str) -> Memo:
    """A worker's memo over a sentencepiece vocabulary that puts a space in front of a text.

    Every text here begins with a space, and the library adds just that one.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
    mark = [model.piece_to_id(MARK)]

    def encode_all(texts: list[str]) -> list[list[int]]:
        found = model.encode([t[1:] for t in texts], num_threads=1)
        return [ids or mark[: len(t)] for t, ids in zip(texts, found, strict=True)]

    return Memo(encode_all, np.array([len(b) for b in piece_bytes(model)], np.int64))


def token_bytes(name: str) -> list[bytes]:
    """What each id of a byte-level vocabulary spells.

    Printable bytes stand for themselves; the others, in order, for the characters from 256 on.
    """
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    spell = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
    model = Tokenizer.from_file(vocabulary_path(name))
    found = [b""] * model.get_vocab_size()
    for token, i in model.get_vocab().items():
        found[i] = bytes(spell[c] for c in token)
    return found


def piece_bytes(model) -> Iterable[bytes]:
    """What each id of a sentencepiece model spells; its mark is a space."""
    out = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:-1], 16)]))
        else:
            out.append(piece.replace(MARK, " ").encode())
    return out
