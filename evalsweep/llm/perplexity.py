"""Quality rules: counts of words, symbols and repeats, and a band of n-gram perplexity per language.

The model is a modified Kneser-Ney model of five characters, one per language,
counted by Spark over all texts.  An n-gram is named by a hash of 60 bits, twelve
per character, from which those of its context and of its shorter forms follow.

Neither the model nor the texts are ever gathered.  The texts are cut into blocks
of rows; the counting pass notes which n-grams each block holds.  The model is
stored in shards as sorted hash arrays with their log probabilities; each shard
answers by binary search what the blocks ask of it, and texts and answers of a
block meet in one task.  All of this grows with the texts, in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalsweep.llm.common import U64, map_batches, mixed, run_starts, slices, staged, text_bytes, texts
from evalsweep.operators.sizing import for_every_salt, with_salt

ORDER, BITS = 5, 12
SYMBOLS = frozenset("#*$%&|<>")
MIN_WORDS, MOST_REPEATED = 50, 50
# Text that a block holds, and the steps of log perplexity that the bands are measured in.
BLOCK_BYTES = 32 << 20
STEPS = 1000
# Parts of the stored model, and the blocks that one of its parts answers in one task.
SHARDS, GROUP_BLOCKS = 64, 1024

# Characters below 2**BITS stand for themselves: space and control characters are one gap, digits one digit.
_KIND = np.arange(1 << BITS, dtype=np.int64)
_KIND[[c for c in range(1 << BITS) if c < 33 or chr(c).isspace()]] = 0
_KIND[[c for c in range(1 << BITS) if chr(c).isdigit()]] = ord("0")


def n_grams(whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of five characters of each text, and where each text's end.

    Small and capital letters are one, gaps count once; a text stands between gaps.
    """
    whole = [text.lower() for text in whole]
    points = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(whole)), [len(t) for t in whole])
    high = points >> BITS > 0
    points[high] = (points[high] * 2654435761 >> 13) & ((1 << BITS - 1) - 1) | 1 << BITS - 1
    symbol = np.where(high, points, _KIND[np.where(high, 0, points)])
    first = np.r_[True, text[1:] != text[:-1]][: len(text)]
    filled = symbol > 0
    kept = filled.copy()
    kept[1:] |= ~first[1:] & filled[:-1]  # the first sign of a gap
    last = np.r_[first[1:], True][: len(text)]
    kept &= filled | ~last  # the gap at the end is added below
    symbol, text = symbol[kept], text[kept]
    sizes = np.bincount(text, minlength=len(whole)) + 1
    ends = np.cumsum(sizes)
    # Four gaps before each text, one after it.
    line = np.zeros(int(sizes.sum()) + (ORDER - 1) * len(whole), np.int64)
    line[np.arange(len(symbol)) + text + (ORDER - 1) * (text + 1)] = symbol
    code = np.zeros(len(line), np.int64)
    for back in range(ORDER):
        code[ORDER - 1 :] |= line[ORDER - 1 - back : len(line) - back] << BITS * back
    own = np.arange(len(code)) - np.repeat(np.arange(len(whole)) * (ORDER - 1), sizes + ORDER - 1)
    begins = np.repeat(ends - sizes, sizes + ORDER - 1)
    return code[own - begins >= ORDER - 1], ends


def base_counts(whole: list[str]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(whole)
    each = [text.encode().split() for text in whole]
    n_words = np.fromiter(map(len, each), np.int64, n)
    flat = pa.array([word for words in each for word in words], pa.binary()).dictionary_encode()
    words, v = flat.indices.to_numpy().astype(np.int64), max(1, len(flat.dictionary))
    ends = np.cumsum(n_words)
    text = np.repeat(np.arange(n), n_words)
    at = np.arange(len(words))
    at = at[at + 3 <= ends[text]]
    _, pair = np.unique(words[at] * v + words[at + 1], return_inverse=True)
    _, triple = np.unique(pair * v + words[at + 2], return_inverse=True)
    _, window, found = np.unique(text[at] * (len(at) + 1) + triple, return_inverse=True, return_counts=True)
    again = at[found[window] > 1]
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + 3, -1)
    covered = np.cumsum(step[:-1]) > 0
    chars, signs, lines = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, whole_text in enumerate(whole):
        chars[i] = len(whole_text) - sum(map(whole_text.count, " \t\n\x0b\x0c\r"))
        signs[i] = sum(map(whole_text.count, SYMBOLS))
        filled = [line for line in whole_text.split("\n") if line.strip(" \t\x0b\x0c\r")]
        lines[i] = len(filled) - len(set(filled))
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": signs,
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(text[covered], minlength=n),
    }


# The model -------------------------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte in planes, compressed; ascending ones as their steps."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(blob: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _steps(ascending: np.ndarray) -> bytes:
    return _packed(np.diff(ascending, prepend=0))


def _from_steps(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob))


def _shard(codes: np.ndarray) -> np.ndarray:
    return (mixed(codes.view(U64)) % U64(SHARDS)).astype(np.int64)


def _blocked(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents with the number of a block of neighbouring rows, the same in every scan, and about how many."""

    def placed(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))

    try:
        rows = placed(docs)
    except AnalysisException:  # not read from files: stored first
        rows = placed(staged(docs, "perplexity-texts"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    most = max(1, min(1 << 20, n * BLOCK_BYTES // max(1, size)))
    return rows.withColumn("block", F.xxhash64("_file", F.expr(f"_at div {most}"))).drop("_file", "_at"), -(-n // most)


def _requests(rows: DataFrame) -> DataFrame:
    """(block, lang, shard, codes, counts): the n-grams of each block, ascending and packed, and how often it has them."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, own = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, own, np.concatenate([n for _, n in parts]))
        return codes, counts

    def sent(block: int, lang: str, parts: list) -> pa.RecordBatch:
        codes, counts = summed(parts)
        order = np.argsort(_shard(codes), kind="stable")
        codes, counts = codes[order], counts[order]
        cuts = run_starts(_shard(codes))
        pieces = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([block] * len(pieces), pa.int64()),
                "lang": pa.array([lang] * len(pieces), pa.string()),
                "shard": pa.array(_shard(codes[cuts[:-1]]), pa.int32()),
                "codes": pa.array([_steps(codes[own]) for own in pieces], pa.binary()),
                "counts": pa.array([_packed(counts[own]) for own in pieces], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for lo, hi in slices(batch, 1 << 20):
                part = batch.slice(lo, hi - lo)
                codes, ends = n_grams(texts(part))
                keys = list(zip(part.column("block").to_pylist(), part.column("lang").to_pylist()))
                group = {key: i for i, key in enumerate(dict.fromkeys(keys))}
                owner = np.repeat([group[key] for key in keys], np.diff(np.r_[0, ends]))
                for key, i in group.items():
                    held.setdefault(key, []).append(np.unique(codes[owner == i], return_counts=True))
            if sum(len(c) for parts in held.values() for c, _ in parts) > 1_000_000:
                held = {key: [summed(parts)] for key, parts in held.items()}
                # Oldest first: rows come block by block.
                while held and sum(len(c) for parts in held.values() for c, _ in parts) > 500_000:
                    key = next(iter(held))
                    yield sent(*key, held.pop(key))
        for key, parts in held.items():
            yield sent(*key, parts)

    return rows.select("block", "lang", "text").mapInArrow(
        run, "block long, lang string, shard int, codes binary, counts binary"
    )


def _counted(requests: DataFrame) -> DataFrame:
    """(lang, code, c) over all blocks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, codes, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "codes", "counts"))):
                codes = _from_steps(codes)
                spoken = pa.DictionaryArray.from_arrays(np.zeros(len(codes), np.int32), [lang]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([spoken, pa.array(codes), pa.array(_unpacked(counts))], ["lang", "code", "n"])

    rows = requests.select("lang", "codes", "counts").mapInArrow(unpack, "lang string, code long, n long")
    return rows.groupBy("lang", "code").agg(F.sum("n").alias("c"))


def _discounts(grams: DataFrame) -> DataFrame:
    """Three discounts per language, from how many n-grams occur once to four times."""
    n = {i: F.count_if(F.col("c") == i).cast("double") for i in (1, 2, 3, 4)}
    counted = grams.groupBy("lang").agg(*[n[i].alias(f"n{i}") for i in n])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> Column:
        found = i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        # Counts too few to tell: the middle of what is possible.
        usable = (F.col("n1") > 0) & (found > 0) & (found < i)
        return F.when(usable, found).otherwise(F.lit(i / 2)).alias(f"d{i}")

    return counted.select("lang", discount(1), discount(2), discount(3))


def _beside(rows: DataFrame, per_language: DataFrame, *spread: str) -> DataFrame:
    """Join a table of one row per language; a language with most rows is spread over many tasks."""
    salts = min(256, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return with_salt(rows, salts, *spread).join(for_every_salt(per_language, salts), ["lang", "_salt"]).drop("_salt")


def log_model(counts: DataFrame) -> DataFrame:
    """(lang, code, logp): interpolated modified Kneser-Ney for every counted n-gram.

    The longest n-grams go by how often they occur, shorter ones by how many
    different characters stand before them.  ``counts`` holds (lang, code, c).
    """
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("code").bitwiseAND(F.lit((1 << BITS * order) - 1))
        fewer = levels[order + 1].select("lang", shorter.alias("code")).groupBy("lang", "code").agg(F.count("*").alias("c"))
        levels[order] = staged(fewer, "kneser-ney-counts")
    below = None
    for order in range(1, ORDER + 1):
        grams = _beside(levels[order], _discounts(levels[order]), "code")
        # What follows one context: at most as many rows as there are symbols.
        context = Window.partitionBy("lang", F.shiftright("code", BITS))
        c = F.col("c")
        taken = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        total = F.sum("c").over(context)
        grams = grams.select(
            "lang",
            "code",
            ((c - taken) / total).alias("own"),
            (F.sum(taken).over(context) / total).alias("rest"),
            F.col("code").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)).alias("shorter"),
        )
        if below is None:
            grams = grams.withColumn("p", F.col("own") + F.col("rest") / (1 << BITS))
        else:
            lower = below.select("lang", F.col("code").alias("shorter"), F.col("p").alias("lower"))
            grams = grams.join(lower, ["lang", "shorter"]).withColumn("p", F.col("own") + F.col("rest") * F.col("lower"))
        below = staged(grams.select("lang", "code", "p"), "kneser-ney")
    return below.select("lang", "code", F.log("p").alias("logp"))


def _stored(model: DataFrame) -> DataFrame:
    """(lang, shard, hashes, logps): the model as sorted hash arrays, cut into shards by a hash."""

    def number(batch: pa.RecordBatch) -> dict:
        codes = batch.column("code").to_numpy()
        return {"lang": batch.column("lang"), "shard": _shard(codes), "code": codes, "logp": batch.column("logp")}

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        codes = rows.column("code").to_numpy()
        order = np.argsort(codes)
        logps = rows.column("logp").to_numpy()[order].astype(np.float32)
        values = key[0].as_py(), key[1].as_py(), _steps(codes[order]), logps.tobytes()
        return pa.table([[value] for value in values], schema=kinds)

    kinds = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("hashes", pa.binary()), ("logps", pa.binary())])
    numbered = map_batches(model, number, "lang string, shard int, code long, logp double")
    packed = numbered.groupBy("lang", "shard").applyInArrow(pack, "lang string, shard int, hashes binary, logps binary")
    return staged(packed, "kneser-ney-arrays")


def _looked_up(requests: DataFrame, arrays: DataFrame, groups: int) -> DataFrame:
    """(block, lang, codes, logps): log probabilities of what each block asked for.

    A shard answers the blocks in ``groups`` groups, so that no task gets the
    requests of all blocks.
    """
    asked = requests.select(
        "block", "lang", "shard", "codes", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("part")
    )
    every = arrays.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    kinds = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("logps", pa.binary())])

    def work(key: tuple, asked: pa.Table, arrays: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return kinds.empty_table()
        hashes = _from_steps(arrays.column("hashes")[0].as_py())
        logps = np.frombuffer(arrays.column("logps")[0].as_py(), np.float32)
        found = [_packed(logps[np.searchsorted(hashes, _from_steps(c))]) for c in asked.column("codes").to_pylist()]
        columns = [asked.column(name) for name in ("block", "lang", "codes")]
        return pa.table([*columns, pa.array(found, pa.binary())], schema=kinds)

    keys = ["lang", "shard", "part"]
    return asked.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(
        work, "block long, lang string, codes binary, logps binary"
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCORED = (
    "doc_id long, lang string, " + ", ".join(f"{name} long" for name in MEASURES) + ", n_grams long, log_perplexity double"
)


def _measured(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Counts and log perplexity of every text, block by block."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            cuts = run_starts(batch.column("block").to_numpy())
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = batch.slice(a, b - a)
                for lo, hi in slices(own, 512 << 10):
                    part = own.slice(lo, hi - lo)
                    data, offsets = text_bytes(part.column("text"))
                    values = (
                        part.column("block")[0].as_py(), part.column("doc_id").to_pylist(), part.column("lang").to_pylist(),
                        np.diff(offsets), pack(data.tobytes()),
                    )
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, squeezed)], schema=squeezed)

    squeezed = pa.schema(
        [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())),
         ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())]
    )
    packed = rows.select("block", "doc_id", "lang", "text").mapInArrow(
        squeeze, "block long, ids array<long>, langs array<string>, sizes array<long>, texts binary"
    )
    kinds = pa.schema(
        [("doc_id", pa.int64()), ("lang", pa.string())]
        + [(name, pa.int64()) for name in MEASURES]
        + [("n_grams", pa.int64()), ("log_perplexity", pa.float64())]
    )

    def work(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        pieces: dict[str, list] = {}
        for lang, codes, logps in zip(*(answers.column(c).to_pylist() for c in ("lang", "codes", "logps"))):
            pieces.setdefault(lang, []).append((_from_steps(codes), _unpacked(logps, np.float32)))
        model = {}
        for lang, found in pieces.items():
            codes, one = np.unique(np.concatenate([c for c, _ in found]), return_index=True)
            model[lang] = codes, np.concatenate([p for _, p in found])[one].astype(np.float64)
        number = {lang: i for i, lang in enumerate(model)}
        out = []
        for ids, langs, sizes, blob in zip(*(docs.column(c).to_pylist() for c in ("ids", "langs", "sizes", "texts"))):
            data, ends = unpack(blob), np.cumsum(sizes)
            whole = [data[b - n : b].decode() for b, n in zip(ends.tolist(), sizes)]
            codes, ends = n_grams(whole)
            sizes = np.diff(np.r_[0, ends])
            owner = np.repeat(np.arange(len(whole)), sizes)
            total = np.zeros(len(whole))
            spoken = np.array([number[lang] for lang in langs])[owner]
            for i, (hashes, logps) in enumerate(model.values()):
                own = np.flatnonzero(spoken == i)
                total += np.bincount(owner[own], logps[np.searchsorted(hashes, codes[own])], minlength=len(whole))
            columns = base_counts(whole)
            arrays = [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), *(pa.array(columns[name]) for name in MEASURES)]
            out.append(pa.RecordBatch.from_arrays([*arrays, pa.array(sizes), pa.array(-total / sizes)], schema=kinds))
        return pa.Table.from_batches(out, schema=kinds)

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, SCORED)


def bands(scored: DataFrame, width: float, least_spread: float) -> DataFrame:
    """(lang, low, high): around the median by ``width`` times the distance to each quartile.

    Quartiles are exact to a step of ``1 / STEPS``; a distance counts as
    ``least_spread`` at least.
    """
    step = F.floor(F.col("log_perplexity") * STEPS).alias("step")
    steps = scored.select("lang", step).groupBy("lang", "step").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("lang").orderBy("step"))
    of = F.sum("n").over(Window.partitionBy("lang"))
    shares = steps.select("lang", F.col("step"), (up_to / of).alias("share"))

    def quartile(share: float) -> Column:
        return F.min(F.when(F.col("share") >= share, F.col("step"))) / STEPS

    found = shares.groupBy("lang").agg(*[quartile(q).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)])
    middle = F.col("q50")
    return found.select(
        "lang",
        (middle - width * F.greatest(middle - F.col("q25"), F.lit(least_spread))).alias("low"),
        (middle + width * F.greatest(F.col("q75") - middle, F.lit(least_spread))).alias("high"),
    )


def judge_quality(docs: DataFrame, width: float = 5.0, least_spread: float = 0.02, short: float = 1.5) -> DataFrame:
    """Counts, perplexity, band and verdict of every row.

    Columns: ``doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_grams, log_perplexity, low, high, base_failed, kept``.  Words
    are what ASCII white space parts.  ``base_failed`` marks fewer than 50 words,
    or more than half of them in runs of three words that the text has twice.  A
    row is kept if it has not failed and its log perplexity (nats a character,
    under the model of its language) lies within the band of its language, which
    is wider by ``short / sqrt(n_grams)`` to both sides: the mean over a short text
    scatters more.

    Null and empty texts have no words and fail; a null language is a language of
    its own, named by the empty text; a null id stays null; repeated rows count
    and are judged each; other columns are left out; an empty table gives an empty
    one.  Texts of any length are read whole, in the memory of one task.
    """
    rows = docs.selectExpr(
        "cast(doc_id as long) as doc_id", "cast(text as string) as text", "coalesce(cast(lang as string), '') as lang"
    )
    rows, n_blocks = _blocked(rows)
    requests = staged(_requests(rows), "perplexity-requests")
    arrays = _stored(log_model(staged(_counted(requests), "perplexity-counts")))
    answers = _looked_up(requests, arrays, max(1, -(-n_blocks // GROUP_BLOCKS)))
    scored = staged(_measured(rows, answers), "perplexity-scores")
    judged = _beside(scored, bands(scored, width, least_spread), "doc_id", "log_perplexity")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed)
    scatter = short / F.sqrt("n_grams")
    judged = judged.withColumns({"low": F.col("low") - scatter, "high": F.col("high") + scatter})
    within = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    names = ("doc_id", "lang", *MEASURES, "n_grams", "log_perplexity", "low", "high", "base_failed")
    return judged.select(*names, (~F.col("base_failed") & within).alias("kept"))
