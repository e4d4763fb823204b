"""Packing documents into sequences by best fit and a swap-based local search.

Documents are tokenized on the executors; only piece lengths and checksums travel on. Pieces are
dealt by hash into shards of bounded size; each shard is packed by best fit and then improved by
exchanges until it needs no more sequences than its tokens fill, or no exchange is left that helps. The
documents of sequences that stay underfull are dealt anew, into fewer shards, until one is left.

Defined cases: a null or empty text is the single id that ends a document; a null ``doc_id`` and
repeated rows are packed like any other row, dealt apart however many are equal; a text of any
length is encoded whole and cut into pieces; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcorpus.llm.shared import Scratch

CAPACITY = 4096
END = 1


#: How a tokenizer file must split texts and mark the ends of words, for words to be encoded one by one.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


class WordEncoder:
    """Token ids of texts, as little-endian 32-bit bytes, with the ids of seen words kept.

    A tokenizer that lower-cases, drops white space and splits by ``SPLIT`` never joins what white
    space divides, so a text's ids are those of its words in turn. The file says whether it does;
    with any other one, and for texts with its special strings, with control separators (white
    space to Python alone) or with hardly any white space, the text goes to it as it is. ``limit``
    bounds the words kept and ``long`` their mean length in a text; they change time only.
    """

    def __init__(self, path: str, limit: int = 700_000, long: int = 40):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.long = limit, long
        self.seen: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.by_word = self._splits(made)
        self.special = [t["content"].lower() for t in made.get("added_tokens") or []]
        self.parts = regex.compile(SPLIT)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = bytearray(max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith(WORD_END)

    @staticmethod
    def _splits(made: dict) -> bool:
        """Whether the file describes such a tokenizer."""
        steps = (made.get("normalizer") or {}).get("normalizers") or []
        space = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        first = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        model = made.get("model") or {}
        return (
            all(x.get("type") in ("NFC", "Lowercase") or x == space for x in steps)
            and {"type": "Lowercase"} in steps
            and (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": SPLIT}, "Removed", True)
            and all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in made["pre_tokenizer"]["pretokenizers"][1:])
            and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", WORD_END, None)
        )

    def whole(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, words: list[str]) -> None:
        """Words are encoded together and told apart by the ids that end their parts."""
        seen = self.seen
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids
            ends = [k + 1 for k, i in enumerate(ids) if self.last[i]]
            counts = [1 if w.isalpha() else sum(1 for _ in self.parts.finditer(w)) for w in some]
            if len(ends) != sum(counts):
                for w in some:
                    seen[w] = self.whole(w)
                continue
            raw, begin, part = _pack(ids), 0, 0
            for w, n in zip(some, counts, strict=True):
                part += n
                k = ends[part - 1] if part else 0
                seen[w] = raw[4 * begin : 4 * k]
                begin = k

    def _words(self, text: str) -> list[str] | None:
        """The words to look up; None for a text that goes to the tokenizer whole."""
        if not self.by_word or any(x in text for x in "\x1c\x1d\x1e\x1f"):
            return None
        lower = text.lower()
        if any(x in lower for x in self.special):
            return None
        try:
            text.encode("latin-1")
            return lower.split()
        except UnicodeEncodeError:
            # lower case of some other letters depends on their place: the tokenizer's business
            words = text.split()
            return words if len(text) <= self.long * len(words) else None

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text in turn; texts are taken some at a time to bound memory."""
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > 2_000_000:
                yield from self._encode(some)
                some, size = [], 0
        yield from self._encode(some)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.seen) > self.limit:
            self.seen.clear()
        get = self.seen.__getitem__
        found: list[bytes | None] = []
        missed: list[tuple[int, list[str]]] = []
        for t in texts:
            words = self._words(t)
            if words is None:
                found.append(self.whole(t))
                continue
            try:
                found.append(b"".join(map(get, words)))
            except KeyError:
                missed.append((len(found), words))
                found.append(None)
        new: set[str] = set()
        for _, words in missed:
            new.update(words)
        self._learn(list(new.difference(self.seen)))
        for k, words in missed:
            found[k] = b"".join(map(get, words))
        return iter(found)


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a file; a Python worker keeps it, and the words it has seen, from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _pack(ids: list[int]) -> bytes:
    import numpy as np

    return np.asarray(ids, dtype="<u4").tobytes()


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt): documents as ids, cut only where longer than capacity.

    salt: a number of the row, which tells rows apart that are equal in all else.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, tail = word_encoder(path), _pack([end])
        salt = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, raw in zip(ids, encoder.encode([t or "" for t in texts]), strict=True):
                raw += tail
                salt += 1
                for k in range(-(-len(raw) // (4 * capacity))):
                    part = raw[4 * capacity * k : 4 * capacity * (k + 1)]
                    for column, v in zip(out, (i, k, k * capacity, len(part) // 4, zlib.crc32(part), salt), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indexes into ``lengths``: best fit from the longest, then local search.

    The search takes the emptiest bins in turn and moves one of their documents into a fuller
    underfull bin, or exchanges one for one or two shorter ones, or two for one longer in
    between; every step raises the sum of squared fills. It ends when the bins are as few as
    the sum of lengths allows, or when no underfull bin has a step left. Bins of the same
    lengths are one kind, and a pair of kinds without a step is not tried again.
    """
    bins: list[list[tuple[int, int]]] = []
    slack: list[int] = []
    pools: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[i]
        m = mask >> n
        if m:
            s = n + (m & -m).bit_length() - 1
            b = pools[s].pop()
            if not pools[s]:
                mask ^= 1 << s
        else:
            b, s = len(bins), capacity
            bins.append([])
            slack.append(capacity)
        bins[b].append((n, i))
        slack[b] = s - n
        if s > n:
            pools[s - n].append(b)
            mask |= 1 << (s - n)
    least = -(-sum(lengths) // capacity)
    alive = sum(1 for x in bins if x)
    if alive <= least:
        return [[i for _, i in b] for b in bins]
    for b in bins:
        b.sort()
    # kinds of underfull bins; met: kinds by the time they got a first or second bin
    number: dict[tuple[int, ...], int] = {}
    kinds: list[tuple[int, ...]] = []
    members: list[list[int]] = []
    tried: list[int] = []
    met: list[int] = []
    live: list[set[int]] = [set() for _ in range(capacity + 1)]

    def enter(b: int) -> None:
        if not slack[b] or not bins[b]:
            return
        kind = tuple(n for n, _ in bins[b])
        k = number.setdefault(kind, len(kinds))
        if k == len(kinds):
            kinds.append(kind)
            members.append([])
            tried.append(0)
        members[k].append(b)
        if len(members[k]) <= 2:
            met.append(k)
        live[slack[b]].add(k)

    def leave(k: int) -> int:
        b = members[k].pop()
        if not members[k]:
            live[slack[b]].discard(k)
        return b

    def others(k: int, s: int) -> Iterator[tuple[int, int]]:
        """(room, kind) that k has not been tried with; the first time by falling room."""
        if tried[k]:
            for other in dict.fromkeys(met[tried[k] :]):
                if len(members[other]) > (other == k) and (r := slack[members[other][0]]) <= s:
                    yield r, other
        else:
            for r in range(s, 0, -1):
                for other in live[r]:
                    if len(members[other]) > (other == k):
                        yield r, other

    for b in range(len(bins)):
        enter(b)
    changed = True
    while changed and alive > least:
        changed, s = False, capacity
        while s and alive > least:
            for k in sorted(live[s]):
                if step := _step(kinds, k, others(k, s), not tried[k]):
                    break
                tried[k] = len(met)
            else:
                s -= 1
                continue
            changed = True
            give, other, take = step
            low, to = leave(k), leave(other)
            given = [bins[low].pop(bisect_left(bins[low], (n,))) for n in give]
            taken = [bins[to].pop(bisect_left(bins[to], (n,))) for n in take]
            for x in given:
                insort(bins[to], x)
            for y in taken:
                insort(bins[low], y)
            slack[low] += sum(give) - sum(take)
            slack[to] -= sum(give) - sum(take)
            alive -= not bins[low]
            enter(low)
            enter(to)
            if bins[low]:
                # on with the same bin
                s = slack[low]
    return [[i for _, i in b] for b in bins if b]


def _step(kinds, k, others, falling):
    """The best step that fills another bin, no emptier, out of one of kind ``k``: (given, other, taken) or None.

    falling: the others come by falling room, so that none after one of too little room is better.
    """
    mine, best, found = kinds[k], 0, None
    for room, other in others:
        if room <= best:
            if falling:
                break
            continue
        theirs = kinds[other]
        # move: the longest document that fits
        at = bisect_right(mine, room) - 1
        if at >= 0 and mine[at] > best:
            best, found = mine[at], ((mine[at],), other, ())
        for x in mine:
            # one for one: the shortest of theirs that leaves room for x
            at = bisect_left(theirs, x - room)
            if at < len(theirs) and x - theirs[at] > best:
                best, found = x - theirs[at], ((x,), other, (theirs[at],))
            # one for two
            for p, y in enumerate(theirs[:-1]):
                if y >= x:
                    break
                at = bisect_left(theirs, x - room - y, p + 1)
                if at < len(theirs) and x - y - theirs[at] > best:
                    best, found = x - y - theirs[at], ((x,), other, (y, theirs[at]))
        # two for one
        for y in theirs:
            for p, x in enumerate(mine[:-1]):
                if x >= y + room:
                    break
                at = bisect_right(mine, y + room - x, p + 1) - 1
                if at > p and x + mine[at] - y > best:
                    best, found = x + mine[at] - y, ((x, mine[at]), other, (y,))
    return found


def _packer(level: int, capacity: int):
    """A function that packs the pieces of one shard."""

    def run(key, part):
        import numpy as np
        import pyarrow as pa

        lengths = part.column("length").to_numpy()
        bins = pack(lengths.tolist(), capacity)
        order = np.array([i for b in bins for i in b], dtype=np.int64)
        which = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        lengths = lengths[order]
        filled = np.zeros(len(bins), np.int64)
        np.add.at(filled, which, lengths)
        places = np.cumsum(lengths) - lengths - (np.cumsum(filled) - filled)[which]
        out = part.take(pa.array(order)).select(["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
        ids = (np.int64(level) << 56) + (np.int64(key[0].as_py()) << 24) + which
        return out.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(places)).append_column("filled", pa.array(filled[which]))

    return run


def packed(docs: DataFrame, path: str, scratch: Scratch, capacity: int = CAPACITY, shard: int = 20_000, enough: float = 0.99) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    shard: pieces packed by one task. enough: a sequence filled to this share is final; the
    documents of the others are dealt anew with those of other shards.
    """
    left = scratch.keep(token_pieces(docs, path, capacity))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, sequence_id long, offset long, filled long"
    done: DataFrame | None = None
    level, n = 0, left.count()
    while True:
        shards = 1 if n <= 2 * shard else -(-n // shard)
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", "salt", F.lit(level)), F.lit(shards)))
        out = scratch.keep(dealt.groupBy("shard").applyInArrow(_packer(level, capacity), schema))
        open_ = F.col("filled") < int(capacity * enough)
        rest = 0 if shards == 1 else out.where(open_).count()
        # dealing on ends when one shard held all, or when most documents came back
        if rest == 0 or rest > n // 2:
            return (out if done is None else done.unionByName(out)).drop("salt")
        full = out.where(~open_)
        done = full if done is None else done.unionByName(full)
        left, n, level = out.where(open_).drop("sequence_id", "offset", "filled"), rest, level + 1
