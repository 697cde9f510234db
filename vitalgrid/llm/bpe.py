"""BPE encoding as a streaming transducer with bounded lookahead, and its decoder.

The encoding of a word is the one path of tokens in which every neighbouring pair stays apart when it is encoded by
itself, so the last token of each prefix follows from the few positions before it. Only those positions are live;
tokens on the part that all live paths share are stable and leave at once. How far that part can lag behind is bounded
by the merge list: a merge waits for its right neighbour only while that one has a merge of lower rank, so the longest
chain of such merges times the longest token is a sufficient lookahead.

Defined results: a null text is empty and has no tokens; a text of white space has none; the strings of special tokens
in a text become those tokens, as the library does. Repeated rows repeat; other columns of the input do not matter.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import narrow, released

# Chunks (text between blanks) whose ids a worker remembers; longer ones than CHUNK symbols are never remembered.
REMEMBERED = 1_200_000
CHUNK = 48


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


class Transducer:
    """Symbols of one word in, stable tokens out; memory is bounded by the lookahead."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str) -> None:
        self.vocab, self.suffix = vocab, suffix
        self.ranks = {tuple(m): r for r, m in enumerate(merges)}
        self.longest = max(len(t.removesuffix(suffix)) for t in vocab)
        #: Beginnings of tokens, and whether each is itself a token inside a word.
        self.heads = {t[:k]: False for t in vocab for k in range(1, len(t.removesuffix(suffix)) + 1)}
        self.heads |= {t: True for t in vocab if not (suffix and t.endswith(suffix))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bool] = {}
        chain: dict[str, int] = {}
        most = 0
        for left, right in self.ranks:
            depth = 1 + chain.get(right, 0)
            chain[left] = max(chain.get(left, 0), depth)
            most = max(most, depth)
        self.lookahead = (most + 1) * self.longest

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges by rank, leftmost first: the definition, on a few symbols that are all there."""
        rank, none = self.ranks.get, 1 << 60
        waits = [rank(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while waits:
            least = min(waits)
            if least == none:
                break
            at = waits.index(least)
            joined = symbols[at] + symbols[at + 1]
            symbols[at : at + 2] = [joined]
            del waits[at]
            if at:
                waits[at - 1] = rank((symbols[at - 1], joined), none)
            if at < len(waits):
                waits[at] = rank((joined, symbols[at + 1]), none)
        return symbols

    def whole(self, text: str | list[str]) -> list[str]:
        """Tokens of a short word by its definition, for callers that hold the whole word anyway."""
        if len(text) > CHUNK:
            return self.word(text)
        return self.merge([*text[:-1], text[-1] + self.suffix])

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def stands(self, token: str) -> bool:
        """Whether a vocabulary entry encodes to itself."""
        known = self.own.get(token)
        if known is None:
            known = self.own[token] = token in self.vocab and self.merge(self._symbols(token)) == [token]
        return known

    def apart(self, left: str, right: str) -> bool:
        """Whether two tokens stay as they are next to each other."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.merge(self._symbols(left) + self._symbols(right)) == [left, right]
            self.pairs[left, right] = known
        return known

    def word(self, text: str | list[str]) -> list[str]:
        """Tokens of a word that fits into the lookahead: the same path, tried longest token first.

        A position from which nothing goes on is on no path at all, because each prefix has one path only.
        """
        n, suffix, heads = len(text), self.suffix, self.heads
        if n > self.lookahead:
            return list(self.run(text))
        if type(text) is list:
            text = "".join(text)
        whole = text + suffix
        if self.own.get(whole) or (whole in self.vocab and self.stands(whole)):
            return [whole]
        own, pairs = self.own, self.pairs
        tokens: list[str] = []
        # For every token so far: its start and the shorter ones that are left to try there.
        choices: list[tuple[int, list[str]]] = []
        dead: set[int] = set()
        at, before = 0, None
        while at < n:
            fits = []
            for end in range(at + 1, n + 1):
                token = text[at:end]
                kind = heads.get(token)
                if kind is None:
                    break
                if kind and end < n:
                    fits.append(token)
            else:
                token = text[at:] + suffix
                if token in self.vocab:
                    fits.append(token)
            while True:
                while fits:
                    token = fits.pop()
                    stands = own.get(token)
                    if not (stands or (stands is None and self.stands(token))):
                        continue
                    if before is not None:
                        apart = pairs.get((before, token))
                        if not (apart or (apart is None and self.apart(before, token))):
                            continue
                    end = at + len(token)
                    if end not in dead:
                        break
                else:
                    dead.add(at)
                    tokens.pop()
                    at, fits = choices.pop()
                    before = tokens[-1] if tokens else None
                    continue
                break
            tokens.append(token)
            choices.append((at, fits))
            at, before = end, token
        return tokens

    def run(self, word: Iterable[str]) -> Iterator[str]:
        """Tokens of a word given symbol by symbol; the last symbol takes the end-of-word suffix."""
        text, tokens, parents = "", [""], [0]  # positions since the last stable boundary
        symbols = iter(word)
        ahead = next(symbols, None)
        while ahead is not None:
            here, ahead = ahead, next(symbols, None)
            text += here
            end = len(text)
            tail = self.suffix if ahead is None else ""
            for start in range(max(0, end - self.longest), end):
                token = text[start:] + tail
                if token in self.vocab and tokens[start] is not None and self.stands(token):
                    if not tokens[start] or self.apart(tokens[start], token):
                        tokens.append(token)
                        parents.append(start)
                        break
            else:
                tokens.append(None)
                parents.append(-1)
            if end > 2 * self.lookahead:
                done = self._shared(tokens, parents, end)
                yield from self._path(tokens, parents, done)
                # The token before the boundary stays as context for the next pairs.
                text, tokens, parents = text[done:], tokens[done:], [p - done for p in parents[done:]]
                parents[0] = 0
        if text:
            yield from self._path(tokens, parents, len(text))

    def _path(self, tokens: list, parents: list[int], at: int) -> list[str]:
        out = []
        while at > 0:
            out.append(tokens[at])
            at = parents[at]
        return out[::-1]

    def _shared(self, tokens: list, parents: list[int], end: int) -> int:
        """The last position that the paths of all live positions go through."""
        live = {p for p in range(max(0, end - self.longest + 1), end + 1) if tokens[p] is not None}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(parents[last])
        return live.pop()


class Encoder:
    """A tokenizer file (word-end BPE over bytes) read as data; ``ids`` are little-endian 32-bit numbers."""

    def __init__(self, path: str, stream: bool = True) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(self.vocab, merges, model["end_of_word_suffix"] or "")
        self.tokens = self.transducer.word if stream else self.transducer.whole
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(steps[0]["pattern"]["Regex"])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.alphabet = byte_alphabet()
        self.decoder = spec["decoder"] and spec["decoder"]["type"]
        names = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.vocab.items()}
        # Encoding alone holds its two generations next to a decoder's worker, so it remembers half as much.
        self.remembered = REMEMBERED // 2 if stream else REMEMBERED
        self.memory = _Memory(self)
        self.known: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop what is remembered of a task's texts: the worker lives on, its memory should not."""
        self.memory.clear()
        self.memory.old = {}
        self.known.clear()

    def _plain(self, text: str) -> bytes:
        # Lower case goes character by character, so a final sigma is like any other.
        if text.isascii():
            lowered = text.lower()
            if lowered.isalpha():
                return self._word(lowered)
            if lowered[-1:] in (".", ",") and lowered[:-1].isalpha():
                return self._word(lowered[:-1]) + self._word(lowered[-1])
        else:
            lowered = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return b"".join(map(self._word, self.words.findall(lowered)))

    def _word(self, word: str) -> bytes:
        """Ids of one word as the pre-tokenizer cuts them."""
        ids = self.known.get(word)
        if ids is None:
            symbols = word if word.isascii() and word.isprintable() else [self.alphabet[b] for b in word.encode()]
            ids = b"".join(map(self.packed.__getitem__, self.tokens(symbols)))
            if len(word) <= CHUNK:
                if len(self.known) >= self.remembered // 3:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def chunk(self, text: str) -> bytes:
        """Ids of a text, special tokens included."""
        if "<" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text. Words never reach over a blank or a line end, so texts go chunk by chunk."""
        return b"".join(map(self.memory.__getitem__, text.replace("\n", " ").split(" ")))


class _Memory(dict):
    """Chunk -> ids in two generations: when the young one is full it becomes the old one."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encoder.chunk(chunk)
        if len(chunk) <= CHUNK:
            if len(self) >= self.encoder.remembered // 2:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Decoder:
    """Ids in, text out, piece by piece.

    With a byte-level decoder in the file, bytes wait until they complete a character; without any decoder the
    library puts the tokens' own strings one behind another with a blank between them, and so does this.
    """

    def __init__(self, encoder: Encoder) -> None:
        self.plain = encoder.decoder is None
        self.begun = False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        if self.plain:
            self.table: list = encoder.names
        else:
            back = {c: b for b, c in enumerate(encoder.alphabet)}
            special = set(encoder.special)
            self.table = [
                t.encode() if t in special or any(c not in back for c in t) else bytes(back[c] for c in t)
                for t in encoder.names
            ]

    def feed(self, ids: np.ndarray) -> str:
        parts = map(self.table.__getitem__, ids.tolist())
        if not self.plain:
            return self.utf8.decode(b"".join(parts))
        text = " ".join(parts)
        if self.begun and len(ids):
            text = " " + text
        self.begun |= len(ids) > 0
        return text

    def end(self) -> str:
        return "" if self.plain else self.utf8.decode(b"", final=True)


@lru_cache(maxsize=2)
def encoder(path: str, stream: bool = True) -> Encoder:
    """One per Python worker; the file must be installed on every node.

    Without ``stream`` short words are merged by rank at once, which gives the same ids.
    """
    return Encoder(path, stream)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) per row: ids of the whole text, packed as little-endian 32-bit numbers."""
    docs = narrow(df, id_col, text_col)
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [own.encode(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    return docs.mapInArrow(released(run), f"id {id_type}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids, text) of rows (id, ids): the text that the ids stand for."""
    rows = encoded.select("id", "ids")
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for ids in part.column("ids"):
                    numbers, machine = np.frombuffer(ids.as_py() or b"", "<u4"), Decoder(own)
                    pieces = [machine.feed(numbers[k : k + 65536]) for k in range(0, len(numbers), 65536)]
                    texts.append("".join([*pieces, machine.end()]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("ids"), pa.array(texts, pa.string())], ["id", "ids", "text"]
                )

    return rows.mapInArrow(released(run), f"id {id_type}, ids binary, text string")


def with_counts(encoded: DataFrame) -> DataFrame:
    """Adds ``n_tokens`` to rows with packed ids."""
    return encoded.withColumn("n_tokens", (F.length("ids") / 4).cast("long"))
