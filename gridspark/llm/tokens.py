"""Token ids of texts, by the tokenizers library."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import small_batches

#: Words whose ids a worker remembers (and as many older ones), and characters of words that are sent to the library at once.
REMEMBERED, AT_ONCE = 300_000, 5_000
#: Trailing characters that most tokenizers cut off after a letter; which of them this one cuts off is probed.
TAIL = b".,;:!?%$&*#|)"

_OPEN: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts word by word where that is exact, and remembers the words' ids.

    It holds for tokenizers that lower-case and drop white space, so that no token spans it. Other tokenizers, and texts
    with a marker of special tokens, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        probe = ["Aa bB", "aa  \n\tbb", "aabb"]
        two, same, joined = (self.library.encode(x, add_special_tokens=False).ids for x in probe)
        self.by_word = two == same != joined
        self.special = [k.content.encode() for k in self.library.get_added_tokens_decoder().values()]
        self.mark = max(self.special, key=len, default=b"")
        self.by_word &= bool(self.mark) and not any(set(x) & set(b" \n\t\r\x0b\x0c") for x in self.special)
        vocab = self.library.get_vocab()
        self.is_mark = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.is_mark[vocab.get(self.mark.decode(), 0)] = True
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix")
        self.is_end = np.zeros_like(self.is_mark) if suffix else None
        if suffix:
            self.is_end[[k for token, k in vocab.items() if token.endswith(suffix)]] = True
        self.tail = self._cut_off() if self.by_word else b""
        self.remembered = REMEMBERED
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _cut_off(self) -> bytes:
        """The characters of TAIL that, alone and in pairs, are encoded after letters as they are by themselves; none where any pair isn't."""
        ids = lambda x: self.library.encode(x, add_special_tokens=False).ids
        letters = ("a", "ab", "information", "qzx")
        good = [c for c in TAIL.decode() if all(ids(w + c) == ids(w) + ids(c) for w in letters)]
        pairs = all(ids("ab" + c + d) == ids("ab") + ids(c + d) for c in good for d in good)
        return "".join(good).encode() if pairs else b""

    def _again(self, word: bytes) -> bool:
        """Takes a word over from the older ones, if it is there."""
        ids = self.older.get(word)
        if ids is not None:
            self.known[word] = ids
        return ids is not None

    def _send(self, words: list[bytes], mark: bytes, ends: np.ndarray) -> None:
        """``ends[id]``: whether an id ends a word (kept with it), or is the mark between words (not kept)."""
        ids = np.array(self.library.encode_batch_fast([mark.join(words).decode("utf-8")], add_special_tokens=False)[0].ids, np.int64)
        cuts = np.flatnonzero(ends[ids]) + 1
        if mark == self.mark:
            cuts = np.append(cuts, len(ids) + 1)
        if len(cuts) != len(words):
            if mark == self.mark:
                raise ValueError("a special token within a word")
            return self._send(words, self.mark, self.is_mark)
        data, width, drop = ids.astype(self.dtype).tobytes(), self.dtype.itemsize, int(mark == self.mark)
        for word, a, b in zip(words, [0, *cuts[:-1].tolist()], cuts.tolist()):
            self.known[word] = data[a * width : (b - drop) * width]

    def learn(self, words: list[bytes]) -> None:
        """Words without special tokens, many in one text: letters alone with blanks between them, where a word's last token shows it;
        others with a special token between them."""
        plain = [w for w in words if self.is_end is not None and w.decode("utf-8").isalpha()]
        letters = set(plain)
        for group, mark, ends in ((plain, b" ", self.is_end), ([w for w in words if w not in letters], self.mark, self.is_mark)):
            at = 0
            while at < len(group):
                size, end = 0, at
                while end < len(group) and (size < AT_ONCE or end == at):
                    size += len(group[end]) + 1
                    end += 1
                self._send(group[at:end], mark, ends)
                at = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``; null: none."""
        if not self.by_word:
            return [self.whole(x) if x else b"" for x in texts]
        split = [None if x and "<" in x and any(m.decode() in x.lower() or m.decode() in x for m in self.special) else (x or "").encode("utf-8").lower().split() for x in texts]
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        known = self.known
        found = [words and list(map(known.get, words)) for words in split]
        missing = {w for words, ids in zip(split, found) if words and None in ids for w, i in zip(words, ids) if i is None}
        if missing:
            new: set[bytes] = set()
            tails: dict[bytes, tuple[bytes, bytes]] = {}
            for word in missing:
                if self._again(word):
                    continue
                core = word.rstrip(self.tail) if self.tail else word
                if core and core != word and 97 <= core[-1] <= 122:
                    tails[word] = core, word[len(core) :]
                    new.update(tails[word])
                else:
                    new.add(word)
            self.learn(sorted(w for w in new if w not in known and not self._again(w)))
            for word, (core, tail) in tails.items():
                known[word] = known[core] + known[tail]
            found = [[i if i is not None else known[w] for w, i in zip(words, ids)] if words and None in ids else ids for words, ids in zip(split, found)]
        return [self.whole(x) if words is None else b"".join(ids) for x, words, ids in zip(texts, split, found)]


def encoder(path: str) -> WordEncoder:
    """One for each worker and file."""
    if path not in _OPEN:
        _OPEN[path] = WordEncoder(path)
    return _OPEN[path]


def with_ids(docs: DataFrame, path: str, end_id: int, text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, ids): the ids of the whole text with ``end_id`` after them, as little-endian integers of 2 bytes for
    vocabularies up to 65,536, else 4. Null and empty texts have the end id alone. Each worker remembers the
    ids of ``remembered`` words, and of as many older ones: more take memory and save time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        own.remembered = remembered
        end = np.array([end_id], own.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [x + end for x in own.encode(part[text].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", text).mapInArrow(run, f"doc_id {kind}, ids binary")
