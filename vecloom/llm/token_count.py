"""Token counts from a finite-state compilation of a byte-level BPE tokenizer.

Two deterministic transducers work in a row.

* The splitter cuts text into pre-tokens. Its cuts between a visible character and white space that follows fall
  whatever came before: in any state, such a place leads to the same state. A chunk of text is therefore mapped to
  (head, count, tail): what precedes its first such place, the tokens between, and what follows its last. Two
  neighbours compose into one by counting the tokens of tail + head, which is associative. The chunks of a text of
  more than LONG code points are rows of their own: tasks map them side by side, and each text's maps, of a few words
  each, are then composed in a balanced scan. A stretch that nothing cuts is one head, as long as it is.
* The counter reads a pre-token's bytes; every transition carries the number of tokens that the byte adds to the
  encoding of what has been read (it may be negative). The sum along a path is the pre-token's number of tokens.
  A state is the longest suffix that starts a token of the vocabulary, with the last token of the encoding at each
  place inside it. For each prefix exactly one token can come last: one whose pair with the token before it encodes
  to just these two. States and transitions are compiled when first met and shared by all texts of a worker.

Words with the white space before them recur, and so do pre-tokens, so the counts of those of SHORT characters at most
are remembered; that store and the transducer are emptied when they reach a bound, which costs time only. Special
tokens inside a text count as the library counts them: one each, and no pre-token reaches across them; none holds white
space, so chunks do not cut them. Files that ask for anything else (a normalizer, another splitter, added tokens that
are not special, merges ignored or dropped) are refused.

Defined results: a null text counts as an empty one, with 0 bytes and 0 tokens. Repeated rows are counted alike,
an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import shipped, written

#: Code points of a chunk, and of a text that is cut into chunks; tokens beyond which a text is over the limit.
CHUNK, LONG, LIMIT = 1 << 16, 1 << 20, 512
#: Counts remembered at most, characters of what is remembered, compiled states.
REMEMBERED, SHORT, STATES = 800_000, 48, 300_000
#: Fixed value: the pattern that splits text before the merges. White space is the Unicode property, as in the library.
_SPACE = r"\p{White_Space}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?![^{_SPACE}])|{_SPACE}+"
#: A place where the splitter cuts in any state.
_SYNC = regex.compile(rf"(?<=[^{_SPACE}])(?={_SPACE})")
_NEVER = 1 << 60
#: Fixed value: the characters of the Unicode property White_Space, as ranges. Words with the white space before them.
_BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_words = re.compile(f"[{_BLANKS}]*[^{_BLANKS}]+|[{_BLANKS}]+").findall
_LAST_SYNC = regex.compile(rf"(?r)(?<=[^{_SPACE}])(?={_SPACE})")


def byte_letters() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes: those of Latin-1 that show stand for
    themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _refuse_others(model: dict) -> None:
    """Raises ValueError for a tokenizer file that means more than a byte-level BPE with the usual splitter."""
    splitter, bpe = model.get("pre_tokenizer") or {}, model["model"]
    wrong = {
        "model": bpe.get("type", "BPE") != "BPE",
        "normalizer": bool(model.get("normalizer")),
        "pre_tokenizer": splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space", False) or not splitter.get("use_regex", True),
        "dropout": bool(bpe.get("dropout")),
        "ignore_merges": bool(bpe.get("ignore_merges")),
        "prefix or suffix": bool(bpe.get("continuing_subword_prefix") or bpe.get("end_of_word_suffix")),
        "added_tokens": any(not t["special"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in model.get("added_tokens", [])),
    }
    if any(wrong.values()):
        raise ValueError("cannot count with this tokenizer's " + ", ".join(k for k, v in wrong.items() if v))


class Counter(dict):
    """Word with the white space before it -> number of tokens, compiled from the vocabulary's merges."""

    def __init__(self, vocabulary: str) -> None:
        model = json.loads(vocabulary)
        _refuse_others(model)
        letters = byte_letters()
        as_bytes = lambda s: bytes(map(letters.__getitem__, s))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.ranks = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.ranks}
        self.starts = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        special = [t["content"] for t in model.get("added_tokens", []) if t["special"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.split = regex.compile(PATTERN).findall
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, int]] | None] = {}
        self.counts: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.pairs: dict[tuple[bytes | None, bytes], bool] = {}
        # a state: the suffix, and for each place in it the last token before (None at the start of the pre-token)
        # and the tokens up to there, less those up to the end
        self.keys: list[tuple[bytes, tuple]] = [(b"", ((None, 0),))]
        self.states = {self.keys[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The encoding of data by its merges, lowest rank first, stopped when least parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, at = min((self.ranks.get((parts[i], parts[i + 1]), _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int]] | None:
        """The parts that stand at the token's left (0) or right (1) edge while it is merged, each with the rank
        of the merge that takes it up; None if the token is not its own encoding."""
        known = self.spines.get((token, side))
        if known is None and (token, side) not in self.spines:
            known = [(token, _NEVER)]
            parts = self.merged(token, 2)
            if len(parts) == 2:
                rank = self.ranks.get((parts[0], parts[1]))
                inner = self.spine(parts[side], side) if rank is not None else None
                known = inner and [(token, _NEVER), (parts[side], rank), *inner[1:]]
            elif len(parts) > 2:
                known = None
            self.spines[token, side] = known
        return known

    def follows(self, before: bytes | None, token: bytes) -> bool:
        """Whether token can come after before (or first) in an encoding: it must be its own encoding, and no two
        parts that meet at the border may merge before both are taken up. Of equal ranks the left one goes first."""
        known = self.pairs.get((before, token))
        if known is None:
            left, right = self.spine(before, 1) if before else [], self.spine(token, 0)
            known = right is not None and left is not None and not any((r := self.ranks.get((x, y))) is not None and r < x_until and r <= y_until for x, x_until in left for y, y_until in right)
            self.pairs[before, token] = known
        return known

    def compiled(self, state: int, byte: int) -> tuple[int, int]:
        """Builds the transition of a state under a byte: the next state and the tokens it adds."""
        suffix, lasts = self.keys[state]
        suffix += bytes([byte])
        i = next(i for i in range(len(suffix)) if suffix[i:] in self.tokens and self.follows(lasts[i][0], suffix[i:]))
        added = lasts[i][1] + 1
        lasts = (*((token, n - added) for token, n in lasts), (suffix[i:], 0))
        cut = next(i for i in range(len(suffix)) if suffix[i:] in self.starts)
        key = (suffix[cut:], lasts[cut:])
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        move = self.moves[state][byte] = self.states[key], added
        return move

    def __missing__(self, word: str) -> int:
        if len(self) + len(self.counts) >= REMEMBERED:
            self.clear()
            self.counts.clear()
        if len(self.keys) >= STATES:
            self.reset()
        known, total = self.counts, 0
        for pretoken in self.split(word):
            count = known.get(pretoken)
            if count is None:
                state = count = 0
                moves = self.moves
                for byte in pretoken.encode():
                    move = moves[state].get(byte) or self.compiled(state, byte)
                    state, count = move[0], count + move[1]
                if len(pretoken) <= SHORT:
                    known[pretoken] = count
            total += count
        if len(word) <= SHORT:
            self[word] = total
        return total

    def count(self, text: str) -> int:
        pieces = self.special.split(text) if self.special else [text]
        return len(pieces) - 1 + sum(sum(map(self.__getitem__, _words(p))) for p in pieces)

    def chunk(self, text: str) -> tuple[str, int | None, str]:
        """What a chunk does to what stands around it: head, tokens between, tail; no count if nothing cuts it."""
        first, last = _SYNC.search(text), _LAST_SYNC.search(text)
        if first is None:
            return text, None, ""
        return text[: first.start()], self.count(text[first.start() : last.start()]), text[last.start() :]

    def composed(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def whole(self, maps: list[tuple[str, int | None, str]]) -> int:
        """The tokens of a text from the maps of its chunks, composed pair by pair."""
        while len(maps) > 1:
            maps = [self.composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, count, tail = maps[0] if maps else ("", None, "")
        return self.count(head) + (count or 0) + self.count(tail)


_counters: dict[int, Counter] = {}


def _counter(vocabulary: str) -> Counter:
    key = hash(vocabulary)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(vocabulary)
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of docs (doc_id, text). vocabulary: the text of a tokenizer file
    with a byte-level BPE model. Texts of more than long code points are counted in chunks."""
    _refuse_others(json.loads(vocabulary))
    shipped(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(held.value)
        for batch in batches:
            text = batch.column("text")
            n = [counter.count(t.as_py()) for t in text]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.compute.binary_length(text).cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(held.value)
        for batch in batches:
            maps = [counter.chunk(t.as_py()) for t in batch.column("text")]
            ends = zip(*maps, strict=True) if maps else ((), (), ())
            columns = [pa.array(x, kind) for x, kind in zip(ends, (pa.string(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("at"), *columns], names=["rid", "at", "head", "count", "tail"])

    def composed(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        n = _counter(held.value).whole(list(zip(*(table.column(x).to_pylist() for x in ("head", "count", "tail")), strict=True)))
        return pa.table({"rid": table.column("rid")[:1], "n_tokens": pa.array([n], pa.int64())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = texts.where(F.length("text") <= long).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    # the few long texts get a number of their own, that their chunks meet again under
    far = written(texts.where(F.length("text") > long).withColumn("rid", F.monotonically_increasing_id()))
    if not far.isEmpty():
        chunks = far.select("rid", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("at", "text"))
        maps = written(chunks.repartition("rid", "at").mapInArrow(mapped, "rid long, at int, head string, count long, tail string"))
        sums = maps.groupBy("rid").applyInArrow(composed, "rid long, n_tokens long")
        out = out.unionByName(far.select("rid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes")).join(sums, "rid").drop("rid"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary)
