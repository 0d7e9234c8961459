"""Token counts of a byte-level BPE vocabulary, with a whole-token shortcut.

The vocabulary file (the JSON format of the tokenizers library) is read once,
on the driver, and two facts are worked out there before any text is seen:

* which vocabulary strings encode alone as one token. Being in the vocabulary
  isn't enough: the merges must also lead there, so every string is merged and
  the ones that end as one token are kept (``whole``);
* which code points the library's letter and number classes hold. Its Unicode
  tables are older than those of the ``regex`` module, so every letter and
  number of the latter is put to the library's own pre-tokeniser, in one call,
  and those that it doesn't join are taken out of the classes.

In the tasks a text is cut into pre-tokens by the library's pattern. A
pre-token that is a whole token counts one; only the others are merged, each
once per task as long as it is remembered (at most ``REMEMBER`` of them).

Null text counts as empty: 0 bytes, 0 tokens, not over any limit. Special
strings inside a text count as one token, as the library does by default. A
very long text is read through an iterator, never as a list of pre-tokens;
a very long pre-token (a run of one letter, say) is merged through a heap, in
n log n. Rows are counted one by one: repeated rows, ties and null ids give a
row each. An empty table gives an empty table. Extra columns of any name stay
behind.
"""

from __future__ import annotations

import heapq
import json
from array import array
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirefold.llm.common import Shared, keyed_text, large

#: The library's byte-level pattern, with its letter and number classes open.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a task remembers besides the whole tokens, and the longest of them.
REMEMBER, LONGEST = 1 << 20, 256
#: From this many code points on a text's pre-tokens are not listed.
STREAM = 1 << 20


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes are themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Merges:
    """Merge rules: the rank of each pair of token ids, and the token that each rank makes."""

    #: The rank of a pair without a rule.
    NONE = 1 << 40

    def __init__(self, vocab: dict[str, int], merges: list):
        letters = byte_letters()
        self.first = [vocab[letters[b]] for b in range(256)]
        self.ranks: dict[tuple[int, int], int] = {}
        self.makes = []
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.makes.append(vocab[a + b])

    def count(self, data: bytes) -> int:
        """How many tokens ``data`` ends as, taken as one pre-token."""
        return self._short(data) if len(data) <= 64 else self._long(data)

    def _short(self, data: bytes) -> int:
        """Lowest rank first, leftmost first, over plain lists."""
        rank_of, none = self.ranks.get, self.NONE
        ids = [self.first[b] for b in data]
        ranks = list(map(rank_of, zip(ids, ids[1:]), repeat(none)))  # noqa: B905
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            ids[i] = token = self.makes[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], token), none)
            if i < len(ranks):
                ranks[i] = rank_of((token, ids[i + 1]), none)
        return len(ids)

    def _long(self, data: bytes) -> int:
        """Lowest rank first, leftmost first: a heap of rank and place over a
        linked list. Entries whose pair is gone are passed over."""
        rank_of, n = self.ranks.get, len(data)
        ids = array("i", [self.first[b] for b in data])
        right, left = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heap = [rank << 40 | i for i in range(n - 1) if (rank := rank_of((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        alive, mask = n, (1 << 40) - 1
        while heap:
            x = heapq.heappop(heap)
            i = x & mask
            j = right[i]
            if ids[i] < 0 or j >= n:
                continue
            rank = x >> 40
            if rank_of((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = self.makes[rank], -1
            token = ids[i]
            k = right[i] = right[j]
            alive -= 1
            if k < n:
                left[k] = i
                if (after := rank_of((token, ids[k]))) is not None:
                    heapq.heappush(heap, after << 40 | i)
            if (h := left[i]) >= 0 and (before := rank_of((ids[h], token))) is not None:
                heapq.heappush(heap, before << 40 | h)
        return alive


def whole_tokens(vocab: dict[str, int], merges: Merges) -> list[str]:
    """The vocabulary strings, as text, that encode alone as one token.
    (Those that are no whole UTF-8 text can't be a pre-token.)"""
    back = {c: b for b, c in byte_letters().items()}
    out = []
    for letters in vocab:
        data = bytes(back[c] for c in letters)
        try:
            text = data.decode()
        except UnicodeDecodeError:
            continue
        if merges.count(data) == 1:
            out.append(text)
    return out


def newer_code_points(kind: str, base: str, split) -> list[str]:
    """The code points of ``regex``'s class ``kind`` (L or N) that the
    library's pre-tokeniser doesn't join to ``base``, a member of its own."""
    import regex
    member = regex.compile(rf"\p{{{kind}}}")
    found = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if member.match(c)]
    # Each candidate stands behind the member, behind a line feed.
    joined = {at[0] for _, at in split("".join("\n" + base + c for c in found)) if at[1] - at[0] == 2}
    return [c for i, c in enumerate(found) if 3 * i + 1 not in joined]


def ranges(chars: list[str]) -> str:
    """A regex class body for the characters."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs)


class Vocabulary:
    """What the tasks need of a vocabulary file, worked out on the driver."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = (model.get("type", "BPE") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                 and not split.get("add_prefix_space") and spec.get("normalizer") is None
                 and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                                    "byte_fallback", "ignore_merges")))
        added = spec.get("added_tokens", [])
        if not plain or any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        self.merges = Merges(model["vocab"], model["merges"])
        self.whole = whole_tokens(model["vocab"], self.merges)
        # The longest special string first: the library takes the longest at a place.
        self.special = sorted((t["content"] for t in added), key=lambda s: (-len(s), s))
        splitter = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        newer = {kind: newer_code_points(kind, base, splitter) for kind, base in (("L", "a"), ("N", "1"))}
        self.newer = {kind: ranges(chars) for kind, chars in newer.items()}
        self.first_newer = min((c for chars in newer.values() for c in chars), default=None)

    def counter(self):
        """A function from a text to its number of tokens."""
        import regex
        plain = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}"))
        # Texts below the first newer code point need no differences of classes.
        late = regex.compile(f"[{self.first_newer}-\U0010FFFF]") if self.first_newer else None
        one = {k: rf"[\p{{{k}}}--[{x}]]" if x else rf"\p{{{k}}}" for k, x in self.newer.items()}
        exact = regex.compile(PATTERN.format(L=one["L"], N=one["N"], l=one["L"], n=one["N"]), regex.V1)
        special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        costs = Costs(self)
        cost_of = costs.__getitem__

        def ordinary(text: str) -> int:
            cut = exact if late is not None and not text.isascii() and late.search(text) else plain
            if len(text) < STREAM:
                return sum(map(cost_of, cut.findall(text)))
            return sum(cost_of(m.group()) for m in cut.finditer(text))

        def count(text: str) -> int:
            if special is None or not special.search(text):
                return ordinary(text)
            total = at = 0
            for m in special.finditer(text):
                total += ordinary(text[at:m.start()]) + 1
                at = m.end()
            return total + ordinary(text[at:])
        return count


class Costs(dict):
    """Tokens of each pre-token: whole tokens from the start, others merged when they come."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(dict.fromkeys(vocabulary.whole, 1))
        self._vocabulary, self._most = vocabulary, len(vocabulary.whole) + REMEMBER

    def __missing__(self, piece: str) -> int:
        n = self._vocabulary.merges.count(piece.encode())
        if len(piece) <= LONGEST:
            if len(self) >= self._most:
                self.clear()
                self.update(dict.fromkeys(self._vocabulary.whole, 1))
            self[piece] = n
        return n


def _count(vocabulary: Shared):
    def run(batches):
        count = vocabulary.value.counter()
        for b in batches:
            texts = large(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array([count(t.as_py()) for t in texts], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens of the
    vocabulary at ``path``, over_limit (n_tokens > limit). No shuffle; the
    broadcast is the vocabulary, whatever the size of the table."""
    rows = keyed_text(docs, id_col, text_col).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    shared = Shared(docs.sparkSession, Vocabulary(path))
    counted = rows.mapInArrow(_count(shared), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
