"""Token counts by greedy longest match, in one pass over each word.

The vocabulary is a trie.  Each node has a failure link and the number of
tokens that are popped on the way: where a character has no edge, the longest
match so far is counted and what is left of the word goes on from the link.
So a word costs its length, and pieces are never built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_codes, in_batches, kept, table, text_parts
from .token_store import TOKENIZER, tokenizer_json

END = "</w>"
#: Words that a worker remembers the count of.
CACHE = 200_000


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = (chr(256 + i) for i in range(256))
    return {b: chr(b) if b in plain else next(spare) for b in range(256)}


class Matcher:
    """count(word): tokens by greedy longest match, or None if the word can't be covered."""

    def __init__(self, vocabulary: list[str], end: str = END) -> None:
        """A token that ends in `end` matches at the end of a word only: a word's last character with `end` is one symbol, unlike the character alone."""
        self.byte = byte_chars()
        self.edges: dict[tuple[int, str], int] = {}
        token, parent = [False], [(0, "")]
        for t in vocabulary:
            symbols = [*t[: -len(end) - 1], t[-len(end) - 1 :]] if end and t.endswith(end) and t != end else list(t)
            if not symbols:
                continue
            node = 0
            for c in symbols:
                new = self.edges.get((node, c))
                if new is None:
                    new = len(token)
                    self.edges[node, c] = new
                    token.append(False)
                    parent.append((node, c))
                node = new
            token[node] = True
        children: list[list[int]] = [[] for _ in token]
        for v in range(1, len(token)):
            children[parent[v][0]].append(v)
        self.fail, self.popped = [-1] * len(token), [0] * len(token)
        queue = deque(children[0])
        while queue:
            v = queue.popleft()
            queue.extend(children[v])
            u, c = parent[v]
            if token[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            n, z = self.popped[u], self.fail[u]
            while z >= 0 and (z, c) not in self.edges:
                n, z = n + self.popped[z], self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.edges[z, c], n
        self.end, self.known = end, {}

    def count(self, word: str) -> int | None:
        symbols = [self.byte[b] for b in word.encode()]
        if symbols:
            symbols[-1] += self.end
        edges, fail, popped, node, n = self.edges, self.fail, self.popped, 0, 0
        for c in symbols:
            while (new := edges.get((node, c))) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return None
            node = new
        while node:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return None
        return n

    def remembered(self, word: str) -> int:
        """count(), -1 where there is none."""
        n = self.known.get(word)
        if n is None:
            n = self.count(word)
            n = -1 if n is None else n
            if len(self.known) < CACHE:
                self.known[word] = n
        return n


def _matcher(key: str, vocabulary: list[str]) -> Matcher:
    return kept(__name__, key, lambda: Matcher(vocabulary))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of each row; words are runs of other than ASCII white space, A-Z lower-cased.

    A word that the vocabulary can't cover counts as one token, and as unknown.
    Null and empty texts have none.  Other columns are not read.
    """
    vocabulary = [t for t in json.loads(tokenizer_json(tokenizer))["model"]["vocab"] if not (t.startswith("<|") and t.endswith("|>"))]
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(tokenizer, shipped.value)
        for batch in batches:
            for a, b, texts in text_parts(batch):
                rows, codes, distinct = chunk_codes(texts)
                words = pc.ascii_lower(distinct).to_pylist()
                n = np.fromiter((matcher.remembered(w) if w else 0 for w in words), np.int64, len(words))
                real = np.fromiter((bool(w) for w in words), np.int64, len(words))
                sums = [np.concatenate([[0], np.cumsum(x[codes] if len(words) else np.zeros(0, np.int64))]) for x in (real, np.abs(n), (n < 0).astype(np.int64))]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), *(pa.array(s[rows[1:]] - s[rows[:-1]]) for s in sums)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows, run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
