"""SentencePiece (merge type) encoding and decoding.

A text's tokens are recovered from one table: for each prefix of a word, the one token that ends the encoding of
that prefix. It is found among the tokens that an automaton sees ending there: the candidate whose pair with the last
token of the prefix before it is stable, that is, no merge would cross the border of the two. Reading the table
backwards gives the ids.

A text is first cut where no token of the vocabulary reaches across (`_word_pattern`, judged when the model is read):
before spaces, and between letters and other signs. No merge crosses such a cut, so each different word of a worker's
share is encoded once while it stays in a memo of bounded size.

Rows: a null text is empty, an empty text has no ids; every input row gives one output row, also repeated ones and
rows without an id. Output columns replace input columns of the same name; all others are passed through.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.common import pieces, table

#: Words a worker remembers with their ids, and with their number of tokens; beyond it the memo starts anew, and also
#: beyond so many characters of them. Words longer than LONG_WORD are encoded each time.
MEMO_WORDS, COUNT_WORDS = 500_000, 1_300_000
MEMO_CHARS, LONG_WORD = 16_000_000, 128
_NEVER = float("inf")


class _Memo(dict):
    """key -> what `make` gives; bounded in keys and, where they are words, in characters."""

    def __init__(self, make, most: int):
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):
        value = self.make(key)
        size = len(key) if isinstance(key, str) else 0
        if size > LONG_WORD:
            return value
        self.held += size
        if len(self) >= self.most or self.held > MEMO_CHARS:
            self.clear()
            self.held = size
        self[key] = value
        return value


class PieceModel:
    """Tokens and merge ranks of a model file, and the encoder and decoder on them."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids, self.byte_of, self.id_of, self.rank, self.piece = {}, {}, {}, {}, {}
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                self.byte_of[i] = int(text[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id_of[text], self.rank[text], self.piece[i] = i, -model.get_score(i), text
        self.unknown = model.unk_id()
        self.hidden = {i for i in range(model.get_piece_size()) if model.is_control(i)}
        self.words = re.compile(_word_pattern(self.id_of))
        self.tails: dict[str, list] = {}
        self.heads: dict[str, list] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id_of.items():
            tree = self._merge(text)
            if tree is not None:
                self.tails[text], self.heads[text] = _edge(tree, self.rank, 1), _edge(tree, self.rank, 0)
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.known = {t for t in self.id_of if len(t) == 1}
        self.size = {i: len(t) for i, t in self.piece.items()}
        self.stable = _Memo(lambda pair: self._is_stable(self.piece[pair >> 32], self.piece[pair & 0xFFFFFFFF]), MEMO_WORDS)
        self.memo = _Memo(self._word, MEMO_WORDS)
        self.spans = _Memo(self._lengths, MEMO_WORDS)
        self.packed = _Memo(self._packed, MEMO_WORDS)
        self.counts = _Memo(lambda word: len(self.tokens(word.replace(" ", "▁"))), COUNT_WORDS)

    def _merge(self, text: str):
        """The tree of merges that makes a token of its characters; None if merging ends elsewhere."""
        nodes = [c for c in text]
        names = [c for c in text]
        while len(nodes) > 1:
            ranked = [(self.rank.get(a + b, _NEVER), k) for k, (a, b) in enumerate(zip(names, names[1:]))]
            best, k = min(ranked)
            if best == _NEVER:
                return None
            nodes[k : k + 2] = [(nodes[k], nodes[k + 1])]
            names[k : k + 2] = [names[k] + names[k + 1]]
        return nodes[0]

    def _is_stable(self, left: str, right: str) -> bool:
        """Whether merging `left + right` leaves these two tokens.

        Both grow from characters; the symbols at their border are walked upwards in the order of the merges that
        consume them. A token across the border would be made if it ranks before both of those merges (of equal
        ranks the leftmost goes first: the left token's own, then the one across, then the right token's own).
        """
        rank, tail, head = self.rank, self.tails[left], self.heads[right]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = tail[i], head[j]
            across = rank.get(x + y, _NEVER)
            if across < x_until and across <= y_until and across < _NEVER:
                return False
            if x_until == y_until == _NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def tokens(self, word: str) -> list[int]:
        """Ids of one word, spaces written as U+2581. A character without a token ends a run and becomes its bytes."""
        if self.known.issuperset(word):
            return self._run(word)
        ids: list[int] = []
        for known, group in groupby(word, self.known.__contains__):
            if known:
                ids += self._run("".join(group))
            else:
                ids += [self.byte_ids.get(b, self.unknown) for c in group for b in c.encode("utf-8", "replace")]
        return ids

    def _run(self, word: str) -> list[int]:
        last, stable = [-1] * (len(word) + 1), self.stable
        for end, (token, length) in self.automaton.iter(word):
            end += 1
            if last[end] < 0:
                begin = end - length
                if not begin or stable[last[begin] << 32 | token]:
                    last[end] = token
        ids, end, size = [], len(word), self.size
        while end:
            token = last[end]
            ids.append(token)
            end -= size[token]
        ids.reverse()
        return ids

    def _decoded(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids) and self.piece.keys() >= set(ids):
            return "".join([self.piece[i] for i in ids]).replace("▁", " ")
        parts, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            parts.append(self.piece.get(i, "" if i in self.hidden else " ⁇ "))
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        return "".join(parts).replace("▁", " ")

    def _word(self, word: str) -> tuple[str, str]:
        ids = self.tokens(word.replace(" ", "▁"))
        decoded = self._decoded(ids)
        return ",".join(map(str, ids)), word if decoded == word else decoded

    def _lengths(self, word: str) -> tuple[tuple[int, int], ...]:
        """Of each token of a word, its first character and the one behind it. Byte tokens share their character."""
        word = word.replace(" ", "▁")
        out, at, raw, k = [], 0, 0, None
        for i in self.tokens(word):
            if i in self.byte_of:
                if not raw:
                    raw = len(word[at].encode("utf-8", "replace"))
                out.append((at, at + 1))
                raw -= 1
                at += not raw
            else:
                k = len(self.piece[i]) if i in self.piece else 1
                out.append((at, at + k))
                at += k
        return tuple(out)

    def _packed(self, word: str) -> tuple[int, bytes]:
        """Number of tokens of a word, and `_lengths` as pairs of 32-bit integers."""
        spans = self._lengths(word)
        return len(spans), array("i", [x for span in spans for x in span]).tobytes()

    def split(self, text: str) -> list[str]:
        """A text's words as they are looked up: with the space that is put before a text."""
        return self.words.findall(" " + text.replace("▁", " ")) if text else []

    def encode(self, text: str) -> list[int]:
        return [int(i) for w in self.split(text) for i in self.memo[w][0].split(",")]

    def decode(self, ids: list[int]) -> str:
        return self._decoded(ids).removeprefix(" ")

    def encoded(self, text: str) -> tuple[str, str, int]:
        """Decimal ids joined by commas, the decoded text, the number of ids."""
        found = [*map(self.memo.__getitem__, self.split(text))]
        ids = ",".join([x[0] for x in found])
        return ids, "".join([x[1] for x in found]).removeprefix(" "), ids.count(",") + 1 if ids else 0

    def count(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.split(text)))

    def forget(self) -> None:
        """Free what is remembered of words and pairs."""
        for memo in (self.stable, self.memo, self.spans, self.packed, self.counts):
            memo.clear()

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Of each token, its characters [begin, end) in the text. The space put before a text lies at 0."""
        out, at = [], -1
        for w in self.split(text):
            out += [(max(a + at, 0), max(b + at, 0)) for a, b in self.spans[w]]
            at += len(w)
        return out


def _word_pattern(tokens) -> str:
    """Parts of a text that no token reaches across. In vocabularies without tokens of letters and other signs
    these are the letter runs and the runs of other signs, each with the spaces before it."""
    borders = {(a, b) for t in tokens for a, b in zip(t, t[1:])}
    if any(a != "▁" and b == "▁" for a, b in borders):
        return "(?s).+"
    odd = re.escape("".join(sorted({c for t in tokens for c in t if re.match(r"[^\W\d_]", c) and not c.isalpha()})))
    letter = {c: bool(re.match(rf"[^\W\d_{odd}]", c)) for t in tokens for c in t}
    if any(a != "▁" and letter[a] != letter[b] for a, b in borders):
        return " *[^ ]+| +"
    return rf" *[^\W\d_{odd}]+| *(?:[^\w ]|[\d_{odd}])+| +"


def _edge(tree, rank: dict[str, float], side: int) -> list[tuple[str, float]]:
    """The symbols at one edge of a token from its character up, each with the rank of the merge that consumes it."""
    up = []
    until = _NEVER
    while True:
        name = _name(tree)
        up.append((name, until))
        if isinstance(tree, str):
            return up[::-1]
        until = rank[name]
        tree = tree[side]


def _name(tree) -> str:
    return tree if isinstance(tree, str) else _name(tree[0]) + _name(tree[1])


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(docs: DataFrame, model_path: str | None = None, text: str = "text") -> DataFrame:
    """Input rows with `ids` (decimal, joined by commas), `decoded` and `n_tokens`. The model file is read where tasks run."""
    added = ("ids", "decoded", "n_tokens")
    keep = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([*keep, T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType()), T.StructField("n_tokens", T.LongType())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path or default_model())
        for batch in batches:
            for part in pieces(batch, text, 8 << 20):
                rows = [model.encoded(t or "") for t in part.column(text).to_pylist()]
                columns = [part.column(n) for n in names]
                columns += [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of both."""
    done = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
