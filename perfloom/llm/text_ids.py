"""Token ids of whole texts, with the ids of recurring words remembered.

A tokenizer of the two kinds below never joins what stands on both sides of certain blanks, so
a text's ids are its words' ids one after another. Words recur, so most need no second run of the
tokenizer. Texts of about ``CHARS`` characters are looked up at once: Arrow numbers their words, those remembered first, the
words that are new go through the tokenizer, and all ids are gathered by number. The memory is an Arrow array and the
ids in one numpy array, a few dozen bytes a word, and it is bounded: when it holds more than ``REMEMBERED`` words, the half
of them met most often stays. This changes the time and never the ids. Words longer than ``LONGEST`` are not remembered.

A byte-level vocabulary keeps blanks: a single blank between two words belongs to the second word, and a
single line end between two words is a token of its own. Only texts whose white space is of these two kinds
are taken apart, any other text goes through the tokenizer whole. The other kind drops
white space and case, so texts are taken apart at blanks, tabs and line ends.

A word of Latin letters alone is one piece for both kinds, so it goes straight to the tokenizer's model.

Texts that spell one of the vocabulary's added tokens (such as an end mark) go through the tokenizer whole, and
get the added token's id, as a plain call gives it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from itertools import islice

from .storage import worker_memory

REMEMBERED = 500_000
CHARS = 1 << 22
STOPS = frozenset(".,;:!?")
LONGEST = 64
BLANKS = "\t\n\r"
#: All white space but blanks and line ends.
OTHER_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Letters that are composed already and stay letters in lower case (U+0130 does not).
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch


def text_ids(vocabulary: str, keeps_blanks: bool, end: int, width: int = 4) -> TextIds:
    """One `TextIds` for all tasks that a Python worker runs one after another."""
    return worker_memory(("ids", vocabulary, keeps_blanks, end, width), lambda: TextIds(vocabulary, keeps_blanks, end, width))


class TextIds:
    """``vocabulary``: path of a tokenizers file. ``keeps_blanks``: see above. ``end``: id after each text.
    ``width``: bytes of an id in the result, 4 or, for vocabularies of at most 65,536 ids, 2."""

    def __init__(self, vocabulary: str, keeps_blanks: bool, end: int, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.keeps_blanks, self.kind = keeps_blanks, {2: "H", 4: "I"}[width]
        self.end = self._bytes([end])
        self.line_end = self._whole("\n") if keeps_blanks else b""
        self.stops = {c: self._whole(c) for c in STOPS}
        self.shown = shown_bytes()
        # The words remembered, the ids of each and how many they are, and how often each was met.
        self.words, self.ids = pa.array([], pa.string()), np.array([], f"u{width}")
        self.sizes, self.met = np.array([], "i4"), np.array([], "i4")

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()  # little-endian on the machines Spark runs on

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learned(self, words: list[str]) -> list[bytes]:
        """Ids of words; letters and one mark after them are tokenized apart by both kinds."""
        stopped = {w for w in words if w[-1:] in STOPS and letters(w[:-1].lstrip("\n"))}
        others, kind, tokenize, blank, found = [], self.kind, self.model.tokenize, chr(self.shown[32]), {}
        for word in {w[:-1] if w in stopped else w for w in words}:
            if word.isascii() and word.isalpha():  # the most frequent case, shown as it is
                found[word] = array(kind, [t.id for t in tokenize(blank + word if self.keeps_blanks else word.lower())]).tobytes()
                continue
            text, before = self._spelled(word)
            if LATIN(text, text[:1] == " "):
                if not self.keeps_blanks:
                    text = text.lower()
                shown = text.encode().decode("latin-1").translate(self.shown)
                found[word] = before + array(kind, [t.id for t in tokenize(shown)]).tobytes()
            else:
                others.append((word, text, before))
        whole = self.tokenizer.encode_batch_fast([text for _, text, _ in others], add_special_tokens=False)
        found.update((word, before + self._bytes(e.ids)) for (word, _, before), e in zip(others, whole, strict=True))
        return [found[w[:-1]] + self.stops[w[-1]] if w in stopped else found[w] for w in words]

    def _spelled(self, word: str) -> tuple[str, bytes]:
        """What the tokenizer sees of a word, and the ids before it."""
        if not self.keeps_blanks:
            return word, b""
        return (word[1:], self.line_end) if word[:1] == "\n" else (" " + word, b"")

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids as little-endian integers, with the end id; a null text is an empty one."""
        out, some, chars = [], [], 0
        for text in texts:
            some.append(text or "")
            chars += len(some[-1])
            if chars >= CHARS:
                out += self._encoded(some)
                some, chars = [], 0
        return out + self._encoded(some)

    def parts(self, batch, rows: int = 256):
        """The batch in parts of ``rows`` rows, each with the ids of its texts; parts of about half ``CHARS`` are encoded at once."""
        some, texts, chars = [], [], 0
        for at in range(0, batch.num_rows, rows):
            some.append(batch.slice(at, rows))
            texts += some[-1].column("text").to_pylist()
            chars += sum(len(t or "") for t in texts[-some[-1].num_rows :])
            if chars >= CHARS // 2 or at + rows >= batch.num_rows:
                ids = iter(self.encode(texts))
                for part in some:
                    yield part, list(islice(ids, part.num_rows))
                some, texts, chars = [], [], 0

    def _encoded(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = [self._goes_whole(t) for t in texts]
        split = pc.split_pattern(pa.array([self._line(t) for t, w in zip(texts, whole, strict=True) if not w], pa.string()), " ")
        known = len(self.words)
        numbered = pa.concat_arrays([self.words, split.flatten()]).dictionary_encode()
        at = numbered.indices.to_numpy()[known:]
        fresh = numbered.dictionary[known:].to_numpy(zero_copy_only=False).tolist()
        learned = self._learned(fresh)
        self.words = numbered.dictionary
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(learned), self.ids.dtype)])
        self.sizes = np.concatenate([self.sizes, np.array([len(x) for x in learned], "i4") // self.ids.itemsize])
        self.met = np.concatenate([self.met, np.zeros(len(fresh), "i4")]) + np.bincount(at, minlength=len(self.words)).astype("i4")
        data = gathered(self.ids, self.sizes, at).tobytes()
        upto = np.concatenate([[0], np.cumsum(self.sizes[at], dtype="i8")])[split.offsets.to_numpy()] * self.ids.itemsize
        self._forget([known + i for i, w in enumerate(fresh) if len(w) > LONGEST])
        skipped = len(self.line_end)
        bounds = zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)
        cut = lambda a, b: data[a + skipped : b]
        return [(self._whole(t) if w else cut(*next(bounds))) + self.end for t, w in zip(texts, whole, strict=True)]

    def _forget(self, long: list[int]) -> None:
        """Drop the words numbered ``long`` and, of too many words, those met least; of equals the older ones."""
        import numpy as np
        import pyarrow as pa

        keep = np.delete(np.arange(len(self.words)), long)
        if len(keep) > REMEMBERED:
            keep = np.sort(keep[::-1][np.argsort(-self.met[keep][::-1], kind="stable")[: REMEMBERED // 2]])
            self.met //= 2  # what was met long ago counts less
        if len(keep) < len(self.words):
            self.ids = gathered(self.ids, self.sizes, keep)
            self.words, self.sizes, self.met = self.words.take(pa.array(keep)), self.sizes[keep], self.met[keep]

    def _goes_whole(self, text: str) -> bool:
        """Whether words would not give the text's ids: an added token in it is one id, whatever stands around."""
        return any(t in text for t in self.added) or self.keeps_blanks and not plain(text)

    def _line(self, text: str) -> str:
        """The text with one blank between words; with kept blanks, a line's first word has its line end before it, the text's too."""
        return "\n" + text.replace("\n", " \n") if self.keeps_blanks else blanks_only(text)


def gathered(ids, sizes, at):
    """The ids of the words numbered ``at``, one after another; ``sizes``: how many ids each word has."""
    import numpy as np

    firsts, n = np.cumsum(sizes, dtype="i8") - sizes, sizes[at]
    return ids[np.repeat(firsts[at] - (np.cumsum(n, dtype="i8") - n), n) + np.arange(n.sum())]


def letters(text: str) -> bool:
    """Whether a text is letters alone, in lower case too."""
    return text.isalpha() and text.lower().isalpha()


def shown_bytes() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: those that print are shown as
    themselves, the rest as the characters from 256 on."""
    printed = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    return {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - printed))}


def blanks_only(text: str) -> str:
    """The text with blanks for tabs and line ends; empty words between two of them have no ids."""
    for c in BLANKS:
        text = text.replace(c, " ")
    return text


def plain(text: str) -> bool:
    """Whether all white space of a text is single blanks and line ends between words."""
    if not text or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0].isspace() or text[-1].isspace():
        return not text
    return not any(c in text for c in OTHER_BLANKS)
