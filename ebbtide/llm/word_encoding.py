"""Encoding whole texts with a tokenizer of the tokenizers library, one distinct word at a time.

Both kinds of tokenizer used here split a text by a pattern before merging, and no piece reaches
across a single white-space character between two others, nor from letters into the symbols behind
them. So the ids of a text are those of its words put together. Texts are taken a few at a time: their
words are numbered, each distinct one is looked up once, and those a worker has not met are
encoded: a word of Latin letters alone is one piece, which goes to the tokenizer's model straight; others
as one text of many, with a mark between them that is a piece of its own; a word that
holds the mark is encoded alone. Texts with white space of any other kind
are encoded whole. Strings of special tokens in a text are ordinary text.

A worker keeps at most ``KEPT`` words: when half of that is new, the older half goes, unless it was
asked for meanwhile. A text of more than ``CHARS`` characters is taken in parts cut before words. Both bound
memory and change no id.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ebbtide.llm.shared import kept

KEPT, CHARS, CALL = 300_000, 8 << 20, 1000
#: Texts to take together: the more, the fewer look-ups of a word.
ROWS = 2560
#: ASCII symbols that are a piece of their own behind letters; the apostrophe may join letters after it.
SYMBOLS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Byte-level vocabularies write a byte that is no visible character as one behind the 255th.
BYTES = dict(zip([*range(33), *range(127, 161), 173], range(256, 324)))
#: The letters of Latin-1 that are not ASCII, as such vocabularies write them.
LETTERS = {k: chr(k).encode().decode("latin-1").translate(BYTES) for k in range(128, 256) if chr(k).isalpha()}


class WordEncoder:
    """``spaced``: a word takes the space before it along and a line feed is a piece of its own, as
    in byte-level vocabularies; otherwise the tokenizer drops white space and lowers case."""

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails = {"": b""}
        # between spaces a symbol is one piece, and so is a line feed between words that take their space along
        self.mark, self.between = ("\n", "\n") if spaced else ("|", " | ")
        self.mark_id = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.piece = self.tokenizer.model.tokenize
        self.start = " ".translate(BYTES) if spaced else ""
        # a tokenizer that takes letters otherwise is asked in full
        ascii_letters = "".join(c for c in map(chr, range(128)) if c.isalpha())
        probes = ["a", "Word", "Stra\u00dfe", ascii_letters, "".join(map(chr, LETTERS)), *map(chr, LETTERS)]
        self.straight = all(self._letters(p) == self.direct(" " + p if spaced else p) for p in probes)
        self.straight &= not spaced or all(self._letters("\n" + p) == self.direct("\n" + p) for p in probes)

    def forget(self) -> None:
        """Give back the memory of words."""
        self.known, self.older, self.tails = {}, {}, {"": b""}

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, body: str) -> bytes | None:
        """The ids of Latin letters behind a space, or a line feed of their own; nothing for any other part of a word."""
        start, feed = self.start, b""
        if self.spaced and body[:1] == "\n":
            body, start, feed = body[1:], "", array("I", self.mark_id).tobytes()
        if not body.isalpha():
            return None
        if not body.isascii():
            if max(body) > "\u00ff":
                return None
            body = (body if self.spaced else body.lower()).translate(LETTERS)
        elif not self.spaced:
            body = body.lower()
        return feed + array("I", [token.id for token in self.piece(start + body)]).tobytes()

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words: of a word's letters with the white space before, and of the symbols behind."""
        ids = list(map(self.known.get, words))
        if len(self.known) >= KEPT // 2:
            self.older, self.known = self.known, {}
        if len(self.tails) >= KEPT // 8:
            self.tails = {"": b""}
        known, older, tails, lower = self.known, self.older, self.tails, not self.spaced
        known_of, tail_of, letters = known.get, tails.get, self._letters if self.straight else lambda body: None
        places, heads, behind, bodies, ends = [], [], [], {}, {}
        for place in [i for i, found in enumerate(ids) if found is None]:
            word = words[place]
            body, end = word.rstrip(SYMBOLS), ""
            if len(body) < len(word):
                if body.isalpha() or body.removeprefix("\n").isalpha():
                    end = word[len(body):]
                else:
                    body = word
            if lower and body.isascii():
                body = body.lower()
            found = known_of(body)
            if found is None and ((found := older.get(body)) is not None or (found := letters(body)) is not None):
                known[body] = found
            if found is not None and (tail := tail_of(end)) is not None:
                ids[place] = found + tail if end else found
                continue
            if found is None:
                bodies[body] = None
            if end not in tails:
                ends[end] = None
            places.append(place)
            heads.append(body)
            behind.append(end)
        for into, asked, space in ((known, bodies, " " if self.spaced else ""), (tails, ends, "")):
            self._ask(into, list(asked), space)
        for place, body, end in zip(places, heads, behind):
            ids[place] = known[body] + tails[end] if end else known[body]
        return ids

    def _ask(self, into: dict[str, bytes], parts: list[str], space: str) -> None:
        """Encode parts of words, the first of a line as it is and others behind the space."""
        marked = [p for p in parts if self.mark in p]
        if marked:
            parts = [p for p in parts if self.mark not in p]
        for at in range(0, len(parts), CALL):
            some = parts[at:at + CALL]
            ids = array("I", self.tokenizer.encode_batch_fast([self.between.join([space + p for p in some])], add_special_tokens=False)[0].ids)
            cuts = np.flatnonzero(np.frombuffer(ids, np.uint32) == self.mark_id[0]).tolist()
            if len(self.mark_id) != 1 or len(cuts) != len(some) - 1:
                marked += some
                continue
            data, start = ids.tobytes(), 0
            for part, cut in zip(some, [*cuts, len(ids)]):
                into[part] = data[4 * start:4 * cut]
                start = cut + 1
        for part in marked:
            into[part] = self.direct(part if part[0] == "\n" else space + part)

    def _segments(self, text: str) -> Iterator[str]:
        """Parts of an evenly spaced text, cut at spaces; the first word of a line begins with its line feed."""
        text = ("\n" + text).replace("\n", " \n")[1:] if self.spaced else text.replace("\n", " ")
        at = 0
        while len(text) - at > CHARS and (end := text.find(" ", at + CHARS)) >= 0:
            yield text[at:end]
            at = end + 1
        yield text[at:]

    def _together(self, segments: list[str]) -> list[bytes]:
        split = pc.split_pattern(pa.array(segments, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        look = self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist()).__getitem__
        code, cuts = words.indices.to_numpy(), split.offsets.to_pylist()
        return [b"".join(map(look, code[a:b].tolist())) for a, b in zip(cuts, cuts[1:])]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, source, chars = [], [], 0
        # the line feed put before a text is dropped from its ids
        feed = len(self.direct("\n")) if self.spaced else 0

        def flush() -> None:
            for i, ids in zip(source, self._together(waiting) if waiting else ()):
                out[i].append(ids if out[i] or not feed else ids[feed:])

        for i, text in enumerate(texts):
            if not text:
                continue
            if " ".join(text.split()) != text.replace("\n", " "):
                out[i].append(self.direct(text))
                continue
            for segment in self._segments(text):
                if waiting and chars + len(segment) > CHARS:
                    flush()
                    waiting, source, chars = [], [], 0
                waiting.append(segment)
                source.append(i)
                chars += len(segment)
        flush()
        return [b"".join(parts) for parts in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def encoder(path: str, spaced: bool) -> WordEncoder:
    """The worker's encoder, kept between tasks of one tokenizer."""
    return kept((path, spaced), lambda: WordEncoder(path, spaced))
