"""N-best SentencePiece segmentation: forward Viterbi scores guide a backward A* search.

A text is escaped as the model asks (one mark before it, blanks as marks) and its piece
lattice falls apart at the starts of words, since no piece goes on from a word into a blank.
For each word a forward pass gives the best score of every prefix, and the second. Searching backward from
the word's end, a partial path's score plus the forward score of its prefix is exactly the
best total it can reach, so paths are completed in order of their scores. A text's n best
paths differ from the best in few words: in the n - 1 whose cheapest detour (by the second
score) costs least; those words are searched and their lists merged best first. The ids of
all n paths are built: ``segmentations`` gives them a text, ``encoded`` a path with its
decoded text.

The forward pass runs over all new words of some texts at once, in arrays: letter by letter
from their beginnings, piece length by piece length. Longer words go one at a time.

Scores are the model's; a character that no piece covers costs the least score less ten and
is spelled in byte pieces. Words of a text are looked up in a bounded cache of each worker.

Defined results: a null or empty text has one path without pieces and score 0; equal scores
are ordered by the words' places, then by piece ids from the end; rows that repeat a doc_id
are segmented each; texts and words of any length are segmented whole, with work and memory in proportion to the
longest word (about a kilobyte for each letter of it); a text with the model's mark in
it decodes to a blank there, so ``round_trip`` is false; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.llm.memory import lean
from lumenar.storage import table

MARK = "▁"
BEST = 4
#: The cache of a worker: so many words of so many letters at most.
CACHED_WORDS, CACHED_LETTERS = 500_000, 64
#: Of words of so many letters at most, it holds the best paths of these many.
CACHED_SEARCHES = 20_000
#: So many new words go through one pass in arrays; of fewer than the least, each goes alone.
WORDS_AT_ONCE, LEAST_AT_ONCE = 1 << 15, 500
BYTES_AT_ONCE = 1 << 20
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

Path = tuple[float, tuple[int, ...]]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Partial:
    """A path from a word's end back to ``at``: its last step and the path before it, with a farther jump towards the end.

    Paths of equal scores are ordered by their steps from the end. Two of them part where their common beginning
    ends; jumps double like the digits of a number, so that place is found in as many steps as the logarithm of
    their length, and no path is ever copied.
    """

    __slots__ = ("at", "behind", "depth", "ids", "jump", "up")

    def __init__(self, up: _Partial | None, ids: tuple[int, ...], at: int, behind: float) -> None:
        self.ids, self.at, self.behind = ids, at, behind
        if up is None:
            self.up = self.jump = self
            self.depth = 0
        else:
            far = up.jump
            self.up, self.depth = up, up.depth + 1
            self.jump = far.jump if up.depth - far.depth == far.depth - far.jump.depth else up

    def raised(self, depth: int) -> _Partial:
        node = self
        while node.depth > depth:
            node = node.jump if node.jump.depth >= depth else node.up
        return node

    def __lt__(self, other: _Partial) -> bool:
        a, b = self.raised(other.depth), other.raised(self.depth)
        if a is b:  # one begins the other
            return self.depth < other.depth
        while a.up is not b.up:
            a, b = (a.up, b.up) if a.jump is b.jump else (a.jump, b.jump)
        return a.ids < b.ids

    def spelled(self) -> tuple[int, ...]:
        out: list[int] = []
        node = self
        while node.depth:
            out.extend(node.ids)
            node = node.up
        return tuple(out)


class Lattice:
    """The pieces of a model and the searches over a word's lattice."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]) -> None:
        self.pieces, self.byte_ids = pieces, byte_ids
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - 10
        #: Pieces, and None for what only begins one: a search for longer pieces ends where neither is.
        self.beginnings: dict[str, tuple[int, float] | None] = {piece[:k]: None for piece in pieces for k in range(1, len(piece))}
        self.beginnings.update(pieces)
        self.cache: dict[str, tuple[float, bytes, float]] = {}
        self.older: dict[str, tuple[float, bytes, float]] = {}
        self.searched = lru_cache(CACHED_SEARCHES)(self.search)
        #: The beginnings as a tree in arrays: its k-th edge (node and letter) leads to node k + 1.
        nodes = {beginning: k for k, beginning in enumerate(["", *self.beginnings])}
        self._tree = pa.array(np.array([nodes[b[:-1]] << 21 | ord(b[-1]) for b in self.beginnings], np.int64))
        self._node_ids = np.array([-1, *(-1 if found is None else found[0] for found in self.beginnings.values())], np.int64)
        self._node_scores = np.array([0.0, *(0.0 if found is None else found[1] for found in self.beginnings.values())])

    @classmethod
    def of_file(cls, path: str) -> Lattice:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
            raise ValueError("a piece goes on from a word into a blank: texts can't be cut at words")
        return cls(pieces, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def _edges(self, word: str) -> list[list[tuple[int, int, float]]]:
        """By end: (start, piece id, score) of each edge; id -1 stands for a character in bytes."""
        n, get = len(word), self.beginnings.get
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            for end in range(start + 1, n + 1):
                found = get(word[start:end], 0)
                if found == 0:
                    break
                if found is not None:
                    into[end].append((start, *found))
            if word[start] not in self.pieces:
                into[start + 1].append((start, -1, self.unknown))
        return into

    def _forward(self, into: list[list[tuple[int, int, float]]]) -> list[float]:
        score = [0.0] * len(into)
        for end in range(1, len(into)):
            score[end] = max([score[start] + s for start, _, s in into[end]])
        return score

    def _spelled(self, word: str, start: int, ident: int) -> tuple[int, ...]:
        return (ident,) if ident >= 0 else tuple(self.byte_ids[b] for b in word[start].encode("utf-8", "surrogatepass"))

    def search(self, word: str, n: int) -> list[Path]:
        """The n best paths of a word by backward A*."""
        into = self._edges(word)
        forward = self._forward(into)
        heap = [(-forward[-1], _Partial(None, (), len(word), 0.0))]
        found: list[Path] = []
        passed = [0] * (len(word) + 1)
        while heap and len(found) < n:
            _, path = heapq.heappop(heap)
            at, behind = path.at, path.behind
            if at == 0:
                found.append((behind, path.spelled()))
                continue
            if passed[at] == n:  # n paths from here to the end come before, each with all ways to the beginning
                continue
            passed[at] += 1
            for start, ident, s in into[at]:
                if passed[start] < n:
                    heapq.heappush(heap, (-(forward[start] + s + behind), _Partial(path, self._spelled(word, start, ident), start, behind + s)))
        return found

    def best(self, word: str) -> tuple[float, bytes, float]:
        """Score and ids (as 32-bit integers) of the best path, and what the cheapest detour from it costs.

        One forward pass keeps the best and the second score of every prefix; of equal
        paths it takes the one that the search completes first, with the least ids from the end.
        """
        if got := self.cache.get(word):
            return got
        if not (got := self.older.get(word)):
            got = self._best(word)
        if len(word) <= CACHED_LETTERS:
            self._keep(word, got)
        return got

    def _keep(self, word: str, got: tuple[float, bytes, float]) -> None:
        if len(self.cache) >= CACHED_WORDS:  # the older half goes, words in use stay
            self.cache, self.older = {}, self.cache
        self.cache[word] = got

    def learn(self, words: set[str]) -> None:
        """Take what ``best`` gives for new words into the cache; many go through the forward pass together."""
        new = [word for word in words if len(word) <= CACHED_LETTERS and word not in self.older]
        for first in range(0, len(new), WORDS_AT_ONCE):
            if len(some := new[first : first + WORDS_AT_ONCE]) >= LEAST_AT_ONCE:
                for word, got in self._best_at_once(some):
                    self._keep(word, got)

    def _best_at_once(self, words: list[str]) -> Iterator[tuple[str, tuple[float, bytes, float]]]:
        """``_best`` of many words in arrays.

        Longest words first: a place is (letters before it, word), numbered by letters and then by words,
        so that the words that reach a place are the first so many. Edges come to a place in the order in
        which one word's loop brings them, so sums and ties are the same.
        """
        words = sorted(words, key=len, reverse=True)
        sizes = np.array([len(word) for word in words])
        longest, everyone = int(sizes[0]), np.arange(len(words))
        reach = np.searchsorted(-sizes, -np.arange(longest + 1), "right")  # words of so many letters at least
        places = np.concatenate([[0], np.cumsum(reach)])
        after = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = np.zeros(places[-1], np.int64)  # that which follows a place
        letters[places[after] + np.repeat(everyone, sizes)] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = self._edges_at_once(letters, sizes, reach, places)

        first, second = np.full(places[-1], -np.inf), np.full(places[-1], -np.inf)
        first[: len(words)] = 0.0
        back, ids = np.zeros(places[-1], np.int64), np.zeros(places[-1], np.int64)
        for k in range(longest):
            for starts, ends, idents, scores, bounds in edges:
                a, b = bounds[k], bounds[k + 1]
                if a == b:
                    continue
                start, end, ident = starts[a:b], ends[a:b], idents[a:b]
                value, top = first[start] + scores[a:b], first[end]
                second[end] = np.maximum(np.maximum(second[end], second[start] + scores[a:b]), np.minimum(top, value))
                first[end] = np.maximum(top, value)
                taken = (value > top) | ((value == top) & (ident >= 0) & (ident < ids[end]))
                back[end[taken]], ids[end[taken]] = start[taken], ident[taken]

        last = places[sizes] + everyone
        steps, who = [], everyone[sizes > 0]
        at = last[who]
        while len(who):
            steps.append((who, ids[at], letters[back[at]]))
            at = back[at]
            on = at >= len(words)
            at, who = at[on], who[on]
        who = np.concatenate([s[0] for s in steps[::-1]])
        order = np.argsort(who, kind="stable")
        ident, letter = (np.concatenate([s[k] for s in steps[::-1]])[order] for k in (1, 2))
        spelled, width = self._spelled_at_once(ident, letter)
        ends = 4 * np.cumsum(np.bincount(who[order], weights=width, minlength=len(words)).astype(np.int64))
        data = spelled.tobytes()
        cuts = [0, *ends.tolist()]
        parts = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return zip(words, zip(first[last].tolist(), parts, (first[last] - second[last]).tolist(), strict=True), strict=True)

    def _edges_at_once(self, letters: np.ndarray, sizes: np.ndarray, reach: np.ndarray, places: np.ndarray) -> list[tuple]:
        """By letters of a piece: places where edges start and end, ids (-1: a character in bytes), scores, bounds by letters before."""
        before = np.repeat(np.arange(len(reach)), reach)
        word = np.arange(places[-1]) - places[before]
        on = before < sizes[word]
        before, word = before[on], word[on]
        start, node, edges = places[before] + word, np.zeros(len(word), np.int64), []
        for length in range(1, len(reach)):
            key = node << 21 | letters[places[before + length - 1] + word]
            found = pc.index_in(pa.array(key), self._tree)
            node = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            ident = np.where(node > 0, self._node_ids[node], -1)
            piece = ident >= 0
            some = np.ones(len(ident), bool) if length == 1 else piece
            scores = np.where(piece, self._node_scores[node], self.unknown)[some]
            bounds = np.searchsorted(before[some], np.arange(len(reach) + 1)).tolist()
            edges.append((start[some], (places[before + length] + word)[some], ident[some], scores, bounds))
            on = (node > 0) & (before + length < sizes[word])
            before, word, start, node = before[on], word[on], start[on], node[on]
            if not len(word):
                break
        return edges

    def _spelled_at_once(self, ident: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with those of bytes where a character has none (32-bit integers), and how many each has become."""
        width = np.ones(len(ident), np.int64)
        if not len(bare := np.flatnonzero(ident < 0)):
            return ident.astype(np.uint32), width
        kinds, kind = np.unique(letter[bare], return_inverse=True)
        spelled = [[self.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in kinds.tolist()]
        width[bare] = np.array([len(s) for s in spelled])[kind]
        begin = np.cumsum(width) - width
        out = np.repeat(ident, width)
        bytes_of = np.array([s + [0] * (4 - len(s)) for s in spelled])
        for k in range(4):
            on = width[bare] > k
            out[begin[bare[on]] + k] = bytes_of[kind[on], k]
        return out.astype(np.uint32), width

    def _best(self, word: str) -> tuple[float, bytes, float]:
        n, get = len(word), self.beginnings.get
        least = float("-inf")
        first, second = [0.0] + [least] * n, [least] * (n + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        for start in range(n):
            f, g = first[start], second[start]
            covered = False
            for end in range(start + 1, n + 1):
                found = get(word[start:end], 0)
                if found == 0:
                    break
                if found is None:
                    continue
                ident, s = found
                if end == start + 1:
                    covered = True
                value = f + s
                top = first[end]
                if value > top:
                    second[end] = top if top > g + s else g + s
                    first[end], back[end] = value, (start, ident)
                else:
                    if value > second[end]:
                        second[end] = value
                    if g + s > second[end]:
                        second[end] = g + s
                    if value == top and 0 <= ident < back[end][1]:
                        back[end] = (start, ident)
            if not covered:
                end, s = start + 1, self.unknown
                value, top = f + s, first[end]
                if value > top:
                    second[end] = max(top, g + s)
                    first[end], back[end] = value, (start, -1)
                else:
                    second[end] = max(second[end], value, g + s)
        ids: list[int] = []
        at = n
        while at:
            start, ident = back[at]
            if ident >= 0:
                ids.append(ident)
            else:
                ids.extend(reversed(self._spelled(word, start, ident)))
            at = start
        ids.reverse()
        return first[n], array("I", ids).tobytes(), first[n] - second[n]

    def segment(self, text: str, n: int) -> tuple[list[float], list[bytes]]:
        """Scores and ids (as 32-bit integers) of the n best paths."""
        return next(self.segment_all([text], n))

    def segment_all(self, texts: list[str], n: int) -> Iterator[tuple[list[float], list[bytes]]]:
        """``segment`` of each text; their new words are searched together."""
        cut = [_WORDS.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        infos = [list(map(self.cache.get, words)) for words in cut]
        self.learn({word for words, known in zip(cut, infos, strict=True) for word, info in zip(words, known, strict=True) if info is None})
        best = self.best
        for words, known in zip(cut, infos, strict=True):
            yield self._segmented(words, [info or best(word) for word, info in zip(words, known, strict=True)], n)

    def _segmented(self, words: list[str], infos: list[tuple[float, bytes, float]], n: int) -> tuple[list[float], list[bytes]]:
        scores, picks = self._merged(words, infos, sum([info[0] for info in infos]), n)
        best = [info[1] for info in infos]
        return scores, [self._joined(best, pick) for pick in picks]

    def _merged(self, words: list[str], infos: list[tuple[float, bytes, float]], total: float, n: int) -> tuple:
        costs, places = [info[2] for info in infos], []
        while costs and len(places) < n - 1 and (least := min(costs)) != float("inf"):
            places.append(costs.index(least))
            costs[places[-1]] = float("inf")
        places.sort()
        found = [(self.searched if len(words[i]) <= CACHED_LETTERS else self.search)(words[i], n) for i in places]
        lists = [[infos[i][0] - score for score, _ in paths] for i, paths in zip(places, found, strict=True)]
        # paths as ranks at these places, best first; each is reached once, by its last raised place
        heap, scores, picks = [(0.0, (0,) * len(places), 0)], [], []
        while heap and len(scores) < n:
            cost, ranks, last = heapq.heappop(heap)
            scores.append(total - cost)
            picks.append([(places[k], found[k][r][1]) for k, r in enumerate(ranks) if r])
            for k in range(last, len(places)):
                if ranks[k] + 1 < len(lists[k]):
                    heapq.heappush(heap, (cost - lists[k][ranks[k]] + lists[k][ranks[k] + 1], (*ranks[:k], ranks[k] + 1, *ranks[k + 1 :]), k))
        return scores, picks

    def _joined(self, best: list[bytes], pick: list[tuple[int, tuple[int, ...]]]) -> bytes:
        """Ids of the path that takes these ids at these words and the best elsewhere."""
        if not pick:
            return b"".join(best)
        parts = list(best)
        for i, ids in pick:
            parts[i] = array("I", ids).tobytes()
        return b"".join(parts)


def encode_nbest(lattice: Lattice, text: str, n: int = BEST) -> list[tuple[float, list[int]]]:
    """The n best (score, ids) of a text."""
    scores, paths = lattice.segment(text, n)
    return [(score, array("I", ids).tolist()) for score, ids in zip(scores, paths, strict=True)]


def decoder(path: str) -> list[bytes]:
    """Bytes of each id; control pieces have none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(MARK, " ").encode())
    return out


def decode(table_of: list[bytes], ids) -> str:
    text = b"".join([table_of[i] for i in ids])
    return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Lattice, list[bytes]]:
    return Lattice.of_file(path), decoder(path)


SCHEMA = "doc_id long, n_pieces long, score double, scores array<double>, ids array<array<int>>, ids_crc32 long, second_crc32 long, round_trip boolean"
PATH_SCHEMA = "doc_id long, rank int, score double, ids array<int>, decoded string"


def _id_lists(paths: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(ids) // 4 for ids in paths])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(paths), np.int32)))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of some bytes of text, one row at least: the ids of n paths are several times the text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first, filled = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > first and filled + size > BYTES_AT_ONCE:
                yield batch.slice(first, i - first)
                first, filled = i, 0
            filled += size
        yield batch.slice(first)


def segmentations(docs: DataFrame, n: int = BEST, path: str | None = None) -> DataFrame:
    """Per row of (doc_id, text): pieces and score of the best path, the n best scores and id lists, checksums of the two best id lists, round trip."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, pieces = _loaded(path)
        for batch in _parts(batches):
            rows, built, ends = [], [], [0]
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for text, (scores, paths) in zip(texts, lattice.segment_all(texts, n), strict=True):
                built += paths
                ends.append(len(built))
                second = zlib.crc32(paths[1]) if len(paths) > 1 else None
                rows.append((len(paths[0]) // 4, scores[0], scores, zlib.crc32(paths[0]), second, decode(pieces, array("I", paths[0])) == text))
            kinds = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.bool_()]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)]
            columns.insert(3, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _id_lists(built)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_pieces", "score", "scores", "ids", "ids_crc32", "second_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(lean(run), SCHEMA)


def encoded(docs: DataFrame, n: int = BEST, path: str | None = None) -> DataFrame:
    """A row for each of the n best paths of (doc_id, text), ranks from 1: score, ids and the text they decode to."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, pieces = _loaded(path)
        for batch in _parts(batches):
            rows, built = [], []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for i, (scores, paths) in enumerate(lattice.segment_all(texts, n)):
                built += paths
                rows.extend((i, rank, score, decode(pieces, array("I", ids))) for rank, (score, ids) in enumerate(zip(scores, paths, strict=True), 1))
            at, rank, score, decoded = zip(*rows, strict=True) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(rank, pa.int32()), pa.array(score, pa.float64()), _id_lists(built), pa.array(decoded, pa.string())],
                ["doc_id", "rank", "score", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(lean(run), PATH_SCHEMA)


def op8_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentations(table(spark, sf_dir, "documents"))
