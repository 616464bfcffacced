"""Token ids and exact token counts of every prefix, for byte-level BPE over words.

Text splits at white space into chunks; a chunk's ids do not depend on its neighbours, so each worker
keeps the ids (or counts) of the chunks it has met, up to a fixed number, and asks for new ones only.

Prefix counts come from dynamic programming over a word. BPE gives exactly one valid encoding, and an
encoding is valid when every two neighbouring tokens stay apart if encoded together. So the last token of
the encoding of w[:j] is the one token t ending at j that stays apart from the last token of
w[:j - len(t)]; its count is one more. A prefix that ends the text ends a word, hence the last token is
one with the end-of-word mark.

Defined cases: a null text is an empty text with no bytes and no tokens; documents are rows, so repeated
rows give repeated results; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerleaf.llm.common import frugal, remembered

#: Chunks and words whose counts a worker remembers at most, and chunks whose ids; then it starts anew.
REMEMBERED, CHUNKS = 800_000, 1_200_000
#: Characters that are split at once.
AT_ONCE = 2_000_000

_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[^{_SPACE}]+")
_CONTRACTION = re.compile("'(?:re|ve|ll)")
#: ASCII marks but for the apostrophe, letters of Latin-1, marks: three words in a row, or fewer.
_MARKED = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def chunks(text: str) -> list[str]:
    """What lies between white space. `str.split` also splits at four control characters."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return _CHUNK.findall(text)
    return text.split()


def vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


@lru_cache(maxsize=2)
def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


class ChunkIds:
    """Ids of texts as bytes of unsigned little-endian 32-bit numbers."""

    def __init__(self, spec: str):
        self.tokenizer, self.known = _tokenizer(spec), {}
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.specials = [t["content"] for t in json.loads(spec)["added_tokens"]]
        letters = [c for c in map(chr, range(0xC0, 0x100)) if c.isalpha()]
        self.units = {ord(c.lower()): cut(c.lower())[0][0] for c in letters}
        #: Whether marks and letters are always words of their own, and letters in either case the same word.
        self.apart = all(
            [span for _, span in cut("".join(parts))] == [(0, a), (a, a + b), (a + b, a + b + c)] and self.tokenizer.normalizer.normalize_str(parts[1]) == parts[1].lower()
            for parts in (("(", "word", "..."), ("$#", "don", "%%%"), ("\"`_", "aÀÖØöøÿßzZ", "}~&")) for a, b, c in [map(len, parts)])

    def _asked(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new chunks. Marks and letters are words of their own, so letters are asked once for all marks about
        them, and of the model itself: there is nothing left to split or to normalise."""
        split = {}
        if self.apart:
            for chunk in new:
                if (found := _MARKED(chunk)) and not any(special in chunk for special in self.specials):
                    before, word, after = found.groups()
                    split[chunk] = before, word.lower(), after
        known, fresh, ask, units = self.known, {"": b""}, self.tokenizer.model.tokenize, self.units
        for word in {three[1] for three in split.values()}.difference(known):
            fresh[word] = array("I", [token.id for token in ask(word if word.isascii() else word.translate(units))]).tobytes()
        rest = {mark for three in split.values() for mark in three[::2] if mark and mark not in known}
        rest.update(chunk for chunk in new if chunk not in split)
        asked = list(rest)
        for chunk, one in zip(asked, self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)):
            fresh[chunk] = array("I", one.ids).tobytes()
        for chunk, three in split.items():
            fresh[chunk] = b"".join([known[part] if (own := fresh.get(part)) is None else own for part in three])
        del fresh[""]
        return fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [chunks(text) for text in texts]
        flat = list(chain.from_iterable(split))
        found = list(map(self.known.get, flat))
        new = list({chunk for chunk, ids in zip(flat, found) if ids is None})
        if new:
            fresh = self._asked(new)
            found = [fresh[chunk] if ids is None else ids for chunk, ids in zip(flat, found)]
            if len(self.known) + len(fresh) > CHUNKS:
                self.known.clear()
            self.known.update(fresh)
        ends = list(accumulate(map(len, split)))
        return [b"".join(found[end - len(part):end]) for part, end in zip(split, ends)]


class PrefixCounts:
    """Token counts of the prefixes of words, chunks and texts."""

    def __init__(self, spec: str):
        self.tokenizer = _tokenizer(spec)
        model = json.loads(spec)["model"]
        self.mark, self.vocab = model["end_of_word_suffix"], model["vocab"]
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.pair = {self.vocab[a] << 32 | self.vocab[b]: (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        #: For each token that comes out as itself: what stood at its left and its right edge, and when (by rank) it was merged away.
        self.left: dict[int, tuple[list[int], list[float]]] = {}
        self.right: dict[int, tuple[list[int], list[float]]] = {}
        self.odd: set[int] = set()
        self.trie: list = [{}, 0, 0]
        for token, number in self.vocab.items():
            inner = token.removesuffix(self.mark)
            chars = [*inner]
            if chars and inner != token:
                chars[-1] += self.mark
            if chars and all(c in self.vocab for c in chars) and self._known_by_itself([self.vocab[c] for c in chars], number):
                node = self.trie
                for char in reversed(inner):
                    node = node[0].setdefault(char, [{}, 0, 0])
                node[2 if inner != token else 1] = number + 1
        self.specials = [t["content"] for t in json.loads(spec)["added_tokens"]]
        letters = "abcdefghijklmnopqrstuvwxyz"
        #: Whether ASCII letters alone are always one word in lower case.
        self.plain = all(self._pieces(t) == [(t.lower(), (0, len(t)))] for t in (letters, letters.upper(), letters[::-1].title()))
        self.apart: dict[int, bool] = {}
        self.words: dict[str, array] = {}
        self.totals: dict[str, int] = {}

    def _known_by_itself(self, parts: list[int], number: int) -> bool:
        """Merge the parts of a token, the lowest rank first and leftmost first; note what happens at its edges."""
        left, right = [[parts[0]], []], [[parts[-1]], []]
        while len(parts) > 1:
            (rank, made), at = min(((self.pair.get(a << 32 | b, (inf, 0)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), key=lambda x: (x[0][0], x[1]))
            if rank == inf:
                return False
            parts = [*parts[:at], made, *parts[at + 2:]]
            for edge, touched in ((left, at == 0), (right, at == len(parts) - 1)):
                if touched:
                    edge[0].append(made)
                    edge[1].append(rank)
        if parts != [number]:
            return False
        for edges, (ids, ranks) in ((self.left, left), (self.right, right)):
            if ranks != sorted(ranks):
                self.odd.add(number)
            edges[number] = ids, [*ranks, inf]
        return True

    def _merge_apart(self, left: int, right: int) -> bool:
        """Whether two tokens, encoded together, come out as these two: no two of what stands at their border, as long as
        both stand there, is merged before either is merged away from the border."""
        (a_s, a_until), (b_s, b_until) = self.right[left], self.left[right]
        i = j = 0
        while True:
            rank = self.pair.get(a_s[i] << 32 | b_s[j], (inf, 0))[0]
            until_a, until_b = a_until[i], b_until[j]
            if rank < until_a and rank <= until_b:
                return False
            if until_a <= until_b:  # of one rank, the left pair goes first
                if until_a == inf:
                    return True
                i += 1
            else:
                j += 1

    def _stay_apart(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (found := self.apart.get(key)) is None:
            if len(self.apart) > 2 * REMEMBERED:
                self.apart.clear()
            if left in self.odd or right in self.odd:
                raise NotImplementedError("a vocabulary whose tokens are merged out of order")
            found = self.apart[key] = self._merge_apart(left, right)
        return found

    def word(self, units: str) -> array:
        """Counts of units[:0], units[:1], ... each taken as a whole word; units are byte characters."""
        if (known := self.words.get(units)) is not None:
            return known
        last, inner, counts, trie, apart = [-1], [0], array("I", [0]), self.trie, self.apart
        for end in range(1, len(units) + 1):
            token = inner_count = count = 0
            node, at = trie, end
            while at:
                at -= 1
                if (node := node[0].get(units[at])) is None:
                    break
                _, open_, closed = node
                if open_ and not token:
                    if not at or ((apart[key] if (key := last[at] << 32 | open_ - 1) in apart else self._stay_apart(last[at], open_ - 1))):
                        token, inner_count = open_, inner[at] + 1
                        if count:
                            break
                if closed and not count:
                    if not at or ((apart[key] if (key := last[at] << 32 | closed - 1) in apart else self._stay_apart(last[at], closed - 1))):
                        count = inner[at] + 1
                        if token:
                            break
            last.append(token - 1)
            inner.append(inner_count)
            counts.append(count)
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        self.words[units] = counts
        return counts

    def _pieces(self, chunk: str) -> list[tuple[str, tuple[int, int]]]:
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(chunk))

    def _asked(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def learn(self, new: list[str]) -> dict[str, int]:
        """Tokens of chunks: those of letters are words as they are, the others are split in one call."""
        found, rest = {}, []
        for chunk in new:
            if self.plain and chunk.isalpha() and chunk.isascii():
                found[chunk] = self.word(chunk.lower())[-1]
            elif any(special in chunk for special in self.specials):
                found[chunk] = self._asked(chunk)
            else:
                rest.append(chunk)
        whole = self.tokenizer.normalizer.normalize_str(" ".join(rest))
        ends = list(accumulate(len(part) + 1 for part in whole.split(" ")))
        if len(ends) == len(rest):
            totals, k = [0] * len(rest), 0
            for units, (start, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(whole):
                while start >= ends[k]:
                    k += 1
                totals[k] += self.word(units)[-1]
            found.update(zip(rest, totals))
        else:  # a chunk that is nothing, or more than one, once it is normalised
            for chunk in rest:
                found[chunk] = sum(self.word(units)[-1] for units, _ in self._pieces(chunk))
        return found

    def chunks(self, flat: list[str]) -> list[int]:
        """Tokens of each of many chunks."""
        known = list(map(self.totals.get, flat))
        new = {chunk for chunk, n in zip(flat, known) if n is None}
        if not new:
            return known
        fresh = self.learn(list(new))
        if len(self.totals) + len(fresh) > REMEMBERED:
            self.totals.clear()
        self.totals.update(fresh)
        return [fresh[chunk] if n is None else n for chunk, n in zip(flat, known)]

    def chunk(self, chunk: str) -> int:
        """Tokens of a whole chunk."""
        return self.chunks([chunk])[0]

    def inside(self, chunk: str) -> list[int]:
        """Tokens of chunk[:0], chunk[:1], ... Characters that change their number when normalised,
        special tokens and contractions break the words anew at some prefixes; those are asked one by one."""
        plain = self.tokenizer.normalizer.normalize_str(chunk)
        if (any(special in chunk for special in self.specials) or _CONTRACTION.search(plain)
                or any(self.tokenizer.normalizer.normalize_str(c) != p for c, p in zip(chunk, plain)) or len(plain) != len(chunk)):
            return [self._asked(chunk[:end]) for end in range(len(chunk) + 1)]
        counts, before = [0] * (len(chunk) + 1), 0
        for units, (start, end) in self._pieces(chunk):
            table, unit = self.word(units), 0
            for at in range(start, end):
                unit += len(plain[at].encode())
                counts[at + 1] = before + table[unit]
            before = counts[end]
        return counts

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of the chunks, and the tokens up to there."""
        spans = [m.span() for m in _CHUNK.finditer(text)]
        return [end for _, end in spans], list(accumulate(self.chunks([text[start:end] for start, end in spans])))

    def upto(self, text: str, position: int) -> int:
        """Tokens of text[:position], from the stored counts and the chunk that is cut."""
        split = chunks(text[:position])
        if not split:
            return 0
        return sum(self.chunks(split[:-1])) + self.inside(split[-1])[-1]

    def fitting(self, text: str, counts: list[int], limit: int) -> int:
        """Length of the longest prefix of at most `limit` tokens; counts: up to the end of each chunk."""
        if not counts or counts[-1] <= limit:
            return len(text)
        first = bisect_left(counts, limit + 1)  # the chunk that goes beyond
        if chunks(text) == text.split():
            start = len(text) - len(text.split(None, first)[first])
        else:
            start = list(_CHUNK.finditer(text))[first].start()
        chunk = _CHUNK.match(text, start).group()
        before = counts[first - 1] if first else 0
        inside = self.inside(chunk)
        fits = [end for end in range(1, len(chunk)) if before + inside[end] <= limit]
        return start + fits[-1] if fits else start


def chunk_ids(spec: str) -> ChunkIds:
    return remembered(("chunk ids", spec), lambda: ChunkIds(spec))


def prefix_counts(spec: str) -> PrefixCounts:
    return remembered(("prefix counts", spec), lambda: PrefixCounts(spec))


def in_portions(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts in lists of about AT_ONCE characters; a null text is empty."""
    some, chars = [], 0
    for text in texts:
        some.append(text or "")
        chars += len(text or "")
        if chars >= AT_ONCE:
            yield some
            some, chars = [], 0
    if some:
        yield some


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, tables: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, fits_chars (length in code points of
    the longest prefix of at most `limit` tokens) and, with `tables`, ends and counts: the stored prefix
    counts, from which `tokens_upto` answers further questions."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counts(spec.value)
        for batch in batches:
            rows = []
            for portion in in_portions(x.as_py() for x in batch.column(1)):
                split = [chunks(text) for text in portion]
                sizes = counter.chunks(list(chain.from_iterable(split)))
                at = 0
                for text, parts in zip(portion, split):
                    counts = list(accumulate(sizes[at:at + len(parts)]))
                    at += len(parts)
                    total = counts[-1] if counts else 0
                    fits = len(text) if total <= limit else counter.fitting(text, counts, limit)
                    ends = [m.end() for m in _CHUNK.finditer(text)] if tables else None
                    rows.append((len(text.encode()), total, total > limit, fits, ends, counts if tables else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:6 if tables else 4]], names=names)

    names = [id_col, "n_bytes", "n_tokens", "over_limit", "fits_chars"] + (["ends", "counts"] if tables else [])
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long"
    schema += ", ends array<int>, counts array<int>" if tables else ""
    return docs.select(id_col, text_col).mapInArrow(frugal(count), schema)


def tokens_upto(path: str) -> Callable[[str, int], int]:
    """A function for the token count of any prefix of a text."""
    return prefix_counts(vocabulary(path)).upto
