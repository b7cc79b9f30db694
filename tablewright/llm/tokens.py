"""Exact, cached encoding with a tokenizer file of the ``tokenizers`` library.

The word tokenizers used here split at white space before any merge, so a text's ids are the ids of its
white-space-separated words, one after the other. Each worker keeps the ids of words it has met in a dictionary of
bounded size; only unseen ones go through the tokenizer: plain lower-case words straight to its merges, all others
through the whole of it.
``tests/llm/test_tokens.py`` holds this against plain whole-text encoding.
"""

from __future__ import annotations

import os
import re
import zlib

import pyarrow as pa
import pyarrow.compute as pc

#: Entries at which the dictionary is emptied: just below the number at which Python doubles its table (about 150 MB).
MAX_WORDS = 1_390_000
#: Texts and bytes of them that are split at a time.
STEP_ROWS, STEP_BYTES = 2048, 8 << 20
#: A comma or full stop between a plain letter and white space is a piece of its own; so is the word before it.
POINT = re.compile(rb"[.,](?=[ \n])(?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
#: Words of plain Latin letters with ASCII punctuation behind them fall into two independent pieces.
PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: How byte-level merges spell those letters: a byte above 160 as the character of that number, but for 173;
#: 173 and those below have no visible character and stand in order from 256 on.
SPELLING = {
    c: "".join(chr(323 if b == 173 else b if b > 160 else 162 + b) for b in chr(c).encode())
    for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]
}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def utf8(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode()


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _learn(self, missing: set[bytes]) -> None:
        if len(self.words) + len(missing) > MAX_WORDS:
            self.words.clear()
        words, joined, odd = self.words, [], []
        letters = {w: w.decode() for w in missing if w.isalpha()}
        for word in missing.difference(letters):
            m = PLAIN.fullmatch(text := word.decode())
            if not m:
                odd.append(text)
            elif m[2]:
                joined.append((word, *(x.encode() for x in m.groups())))
                letters[joined[-1][1]] = m[1]
            else:
                letters[word] = text
        # plain letters: nothing is left to do but lower-casing, spelling and the merges
        merge = self.model.model.tokenize
        for word, text in letters.items():
            if word not in words:
                if not text.isascii():
                    text = text.lower().translate(SPELLING)
                words[word] = b"".join([t.id.to_bytes(4, "little") for t in merge(text)])
        odd += [x.decode() for x in {x for _, _, x in joined}.difference(words)]
        words.update(zip([x.encode() for x in odd], self._whole(odd), strict=True))
        for word, first, marks in joined:
            words[word] = words[first] + words[marks]

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words, unseen ones learnt; none of an empty word."""
        get = self.words.get
        found = [get(w) for w in words]
        if None in found:
            missing = {w for w, x in zip(words, found) if x is None and w}
            if missing:
                self._learn(missing)
            # what was found before stays, even if the dictionary was emptied since
            found = [get(w, b"") if x is None else x for w, x in zip(words, found)]
        return found

    def _step(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each of a bounded number of texts: a word is looked up once, however often it stands in them."""
        import numpy as np

        # ASCII white space, as in bytes.split(); before the first and behind the last one stand empty words
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        _, offsets, letters = coded.dictionary.buffers()  # of an array of its own, so from its start
        letters = letters.to_pybytes() if letters else b""
        at = np.frombuffer(offsets, np.int64, len(coded.dictionary) + 1).tolist()
        found = self._known([letters[a:b] for a, b in zip(at, at[1:])])
        word = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, begins = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        here = sizes[word]
        ends = np.concatenate([[0], np.cumsum(here)])
        place = np.repeat((begins[word] - ends[:-1]).astype(np.int32), here)  # of fewer than 2**31 bytes of text
        place += np.arange(len(place), dtype=np.int32)
        raw = pool[place].tobytes()
        stops = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(stops, stops[1:])]

    def encode(self, texts: list[str | bytes | None]) -> list[bytes]:
        """The ids of each text (or of its UTF-8 bytes) as little-endian unsigned 32-bit integers; a null text has
        none."""
        out: list[bytes] = []
        step, total = [], 0
        for text in texts:
            # the tokenizer lower-cases by itself; doing so for ASCII beforehand only makes the dictionary smaller
            text = POINT.sub(rb" \g<0> ", utf8(text).lower())
            if step and (total + len(text) > STEP_BYTES or len(step) == STEP_ROWS):
                out += self._step(step)
                step, total = [], 0
            step.append(text)
            total += len(text)
        return out + self._step(step) if step else out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def end_bytes(end_id: int) -> bytes:
    return end_id.to_bytes(4, "little")


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
