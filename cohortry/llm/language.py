"""Language identification by cross-parsing entropy."""

from __future__ import annotations

from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, fresh

#: Bound of the training sample: characters per language, in whole texts out of at most BUCKETS.
SAMPLE_CHARS, BUCKETS = 32_000, 64
#: Symbols parsed together; lanes below which texts are parsed one by one.
TOGETHER, FEW_LANES = 4_000_000, 48
UNDETERMINED = "und"


def training_sample(docs: DataFrame, text: str, lang: str, sample_chars: int = SAMPLE_CHARS, buckets: int = BUCKETS) -> dict[str, str]:
    """Text per language, about sample_chars characters at most: whole texts, chosen by hash over all rows.

    Each of `buckets` hash buckets offers its first text; they are taken in the order of their hashes if
    they fit into what is left. If none fits, a stretch of the shortest is taken, at a place given by its hash.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    offered = rows.groupBy("l", F.pmod("h", F.lit(buckets)).alias("b")).agg(F.min(F.struct("h", F.char_length("t").alias("n"))).alias("x"))
    by_lang: dict[str, list] = {}
    for r in offered.select("l", "x.h", "x.n").orderBy("l", "h").collect():  # languages x buckets
        by_lang.setdefault(r["l"], []).append((r["h"], r["n"]))
    chosen = []
    for name, texts in by_lang.items():
        left = sample_chars
        for h, n in texts:
            if n <= left:
                chosen.append((name, h, 1, n))
                left -= n
        if left == sample_chars:
            h, n = min(texts, key=lambda x: x[1])
            chosen.append((name, h, 1 + h % (n - sample_chars + 1), sample_chars))
    if not chosen:
        return {}
    picks = F.broadcast(docs.sparkSession.createDataFrame(chosen, "l string, h long, at int, n int"))
    picked = rows.join(picks, ["l", "h"]).select("l", "h", F.col("t").substr(F.col("at"), F.col("n")).alias("t")).distinct()
    out: dict[str, list[str]] = {}
    for r in picked.orderBy("l", "h").collect():  # languages x sample_chars
        out.setdefault(r["l"], []).append(r["t"])
    return {k: "\n".join(v) for k, v in out.items()}


def symbol_table(texts: list[str]) -> np.ndarray:
    """Code point to symbol: 0 not a letter, 1 a letter not in texts, else one symbol for each lower-case letter in them."""
    symbols = {c: i + 2 for i, c in enumerate(sorted({c for t in texts for c in t.lower() if c.isalpha()}))}
    table = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = symbols.get(c.lower(), 1)
    return table


def symbols_of(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text, runs of non-letters as one."""
    found = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(found) > 1:
        found = found[np.concatenate([[True], (found[1:] > 0) | (found[:-1] > 0)])]
    return found


def suffix_automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the root. Every path from it spells a substring."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in sequence:
        here = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = here
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[here] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = here
    return moves


class Parser:
    """The automaton of a text as flat arrays whose size doesn't depend on the alphabet.

    The transitions of all states but the root share one row of cells: that of state s by symbol c lies
    at base[s] + c and names s, so that a cell of another state is told apart.
    """

    def __init__(self, sequence: np.ndarray, symbols: int):
        moves = suffix_automaton(sequence.tolist())
        count = sum(len(m) for m in moves[1:])
        self.root = np.array([moves[0].get(c, 0) for c in range(symbols)], np.int64)
        self.base = np.zeros(len(moves), np.int64)
        self.cells = np.full(2 * count + 2 * symbols + 1, -1, np.int64)
        cells, room, free, rng = {}, 2 * count + symbols + 1, symbols, np.random.default_rng(1)
        tries = iter(())
        for s in sorted(range(1, len(moves)), key=lambda s: -len(moves[s])):
            m = moves[s]
            if len(m) > 1:  # a place that suits all
                while True:
                    base = next(tries, None)
                    if base is None:
                        tries = iter(rng.integers(0, room, 1 << 14).tolist())
                    elif not any(base + c in cells for c in m):
                        break
            elif m:  # the next free cell
                while free in cells:
                    free += 1
                base = free - next(iter(m))
            else:
                continue
            self.base[s] = base
            for c, to in m.items():
                cells[base + c] = s << 32 | to
        self.cells[np.fromiter(cells, np.int64, len(cells))] = np.fromiter(cells.values(), np.int64, len(cells))

    @property
    def nbytes(self) -> int:
        return self.root.nbytes + self.base.nbytes + self.cells.nbytes


def _count_one(text: list[int], root: list[int], base: list[int], cells: list[int], state: int) -> int:
    """Phrases of one text from a state on."""
    phrases = 0
    for c in text:
        cell = cells[base[state] + c]
        if cell >> 32 == state and state:
            state = cell & 0xFFFFFFFF
        else:
            state = root[c]
            phrases += 1
    return phrases


def count_phrases(texts: list[np.ndarray], parsers: list[Parser]) -> np.ndarray:
    """Phrases of the greedy parse of each text by each parser. All texts step together, from start to
    end; when few are long enough to go on, each of these is finished by itself."""
    out = np.zeros((len(texts), len(parsers)), np.int64)
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    ordered = sizes[order]
    steps = int(ordered[FEW_LANES - 1]) if len(texts) >= FEW_LANES else 0
    flat, starts = np.concatenate([texts[i] for i in order]), np.cumsum(ordered) - ordered
    live = np.searchsorted(-ordered, -np.arange(steps), side="left")
    for j, p in enumerate(parsers):
        state, phrases = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for t, n in enumerate(live):
            c, now = flat[starts[:n] + t], state[:n]
            cell = p.cells[p.base[now] + c]
            stay = (cell >> 32 == now) & (now > 0)
            phrases[:n] += ~stay
            state[:n] = np.where(stay, cell & 0xFFFFFFFF, p.root[c])
        long = [(k, i) for k, i in enumerate(order[:FEW_LANES]) if sizes[i] > steps]
        if long:
            lists = p.root.tolist(), p.base.tolist(), p.cells.tolist()
            for k, i in long:
                phrases[k] += _count_one(texts[i][steps:].tolist(), *lists, int(state[k]))
        out[order, j] = phrases
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample_chars: int = SAMPLE_CHARS, buckets: int = BUCKETS) -> dict:
    """Parsers by language, from rows with a language and a text with letters."""
    sample = training_sample(docs, text, lang, sample_chars, buckets)
    names = sorted(sample)
    table = symbol_table(list(sample.values()))
    learned = [symbols_of(sample[x], table) for x in names]
    parsers = [Parser(x, int(table.max(initial=1)) + 1) for x in learned]
    return {"names": names, "symbols": table, "bits": [log2(len(x) + 1) for x in learned], "parsers": parsers}


def _costed(docs: DataFrame, model: dict, languages: range, text: str, out: str) -> DataFrame:
    """docs with out, the bits that each of the languages needs for the text; null for a text without letters."""
    some = {"symbols": model["symbols"], "bits": np.array([model["bits"][i] for i in languages]), "parsers": [model["parsers"][i] for i in languages]}
    shared, at = docs.sparkSession.sparkContext.broadcast(some), docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                parsed, size, high = [], 0, low
                while high < batch.num_rows and (size < TOGETHER or high == low):
                    s = symbols_of(batch.column(at)[high].as_py() or "", m["symbols"])
                    parsed.append(s if s.any() else s[:0])
                    size += len(s)
                    high += 1
                full, costs = [i for i, s in enumerate(parsed) if len(s)], [None] * len(parsed)
                if full and m["parsers"]:
                    for i, row in zip(full, (count_phrases([parsed[i] for i in full], m["parsers"]) + 1) * m["bits"], strict=True):
                        costs[i] = row.tolist()
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, pa.array(costs, pa.list_(pa.float64()))], schema.names)
                low = high

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, model: dict, text: str = "text", out: str = "lang_pred", score: str = "score", block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with out (a learned language, or "und") and score (0 to 1); they replace columns of those names.

    A text is parsed greedily, whole, into the longest substrings of each language's sample; the language
    whose phrases, times the bits of a pointer into its sample, need the fewest bits wins, the first by
    name in a tie. score is the winner's share of the inverse costs. A text that is null or has no letters,
    and every text if no language was learned, is "und" with score 0. Repeated rows get equal results; an
    empty table stays empty; a very long text is parsed in one go by one task.

    The model is broadcast in blocks of languages of at most block_bytes, each its own pass over the rows.
    """
    kept = [c for c in docs.columns if c not in (out, score)]
    sizes, blocks, start = [p.nbytes for p in model["parsers"]], [], 0
    for i in range(len(sizes)):
        if i > start and sum(sizes[start : i + 1]) > block_bytes - model["symbols"].nbytes:
            blocks.append(range(start, i))
            start = i
    blocks.append(range(start, len(sizes)))
    names = [fresh(f"__costs_{i}", kept) for i in range(len(blocks))]
    found = docs.select(*[docs[c] for c in kept])
    for name, languages in zip(names, blocks, strict=True):
        found = _costed(found, model, languages, text, name)
    costs = F.concat(*names)
    best = F.array_min(costs)
    said = F.get(F.array(*[F.lit(x) for x in model["names"]]).cast("array<string>"), F.array_position(costs, best).cast("int") - 1)
    share = 1 / best / F.aggregate(costs, F.lit(0.0), lambda a, x: a + 1 / x)
    return found.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(said, F.lit(UNDETERMINED)).alias(out), F.coalesce(share, F.lit(0.0)).alias(score))


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
