"""Near-duplicates by SimHash fingerprints and the general pigeonhole principle.

The bits of a fingerprint are grouped into partitions, correlated bits together. If two fingerprints differ in at most
d bits, then for thresholds t_1..t_m with a sum of d - m + 1 they differ in at most t_i bits in some partition i (a
threshold of -1 leaves a partition out). Which thresholds make fewest candidates is found by dynamic programming over
estimated counts. Each partition is then probed, half of its threshold from either side, and candidates are verified:
by their distance, and where texts have to be similar, on the whole sets of their shingles.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, not_guessed, spread_join, table
from .components import components
from .tokenize import release

BITS, DISTANCE, SHINGLE = 64, 4, 4
#: Fingerprints from which costs are estimated. They decide how fast a join is, never what it finds.
SAMPLE = 1024
#: For so many fingerprints the partitions are chosen, however many there are: a row's probes don't grow with the table.
EXPECTED = 1_000_000
#: What a probe costs against a candidate pair.
PROBE_COST = 2.0
#: A key under which more meet is hot; what fewer fingerprints share alone does not make a key hot.
BUCKET, SHARED = 64, 4
#: Of what is left apart under a hot key, as many pairs are compared at once where there are no sketches, and as many without
#: pieces.
PLAIN, WHOLE = 1 << 18, 1 << 26
#: Where sketches tell pairs, under a hot key all are first compared to so many.
PIVOTS = 4
#: Keys up to this number are broadcast.
BROADCAST_KEYS = 100_000
#: Of a text's set of shingles, bits that tell whether an odd number of them falls there.
SKETCH = 1024
#: Sketches of texts up to this number (some 150 bytes each) are broadcast.
BROADCAST_SKETCHES = 50_000
#: Of first_of_each_group(): bits in which fingerprints over single words may differ, and the shingles of the exact check.
WORD_DISTANCE, VERIFY_SHINGLE = 8, 5


def _shingle_hashes(found: list[bytes], shingle: int):
    """Arrays of the hashes of all shingles of the words, some 65,536 at a time."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not found:
        return
    joined, k = b" ".join(found), min(shingle, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    first = [0, *(ends[: len(found) - k] + 1).tolist()]
    last = ends[k - 1 :].tolist()
    for at in range(0, len(first), 65_536):
        yield np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(first[at : at + 65_536], last[at : at + 65_536])], "<u8")


def _majority(hashes) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number; of none: 0."""
    import numpy as np

    ones, n = np.zeros(BITS, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprint(text: bytes, shingle: int) -> int:
    return _majority(_shingle_hashes(text.lower().split(), shingle))  # of bytes: A-Z, and white space of ASCII


def _fingerprints(shingle: int):
    def batches(it):
        import pyarrow as pa

        release()
        for b in it:
            made = pa.array([_fingerprint(t, shingle) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], [*b.schema.names[:-1], "fp"])

    return batches


def fingerprints(docs: DataFrame, carry: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The carried columns and fp long. A null or blank text has the fingerprint 0."""
    rows = docs.select(*carry, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("fp"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_fingerprints(shingle), f"{schema}, fp long")


def _groups(bits, m: int) -> list[list[int]]:
    """m groups of nearly equal size, each grown from a bit by those most correlated with it."""
    import numpy as np

    with np.errstate(all="ignore"):
        c = np.nan_to_num(np.abs(np.corrcoef(bits.T)))
    left, out = list(range(bits.shape[1])), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [left[0]]
        while len(group) < size:
            group.append(max((b for b in left if b not in group), key=lambda b: (c[b, group].sum(), -b)))
        out.append(sorted(group))
        left = [b for b in left if b not in group]
    return out


def _distances(bits):
    """In how many bits each two rows differ."""
    import numpy as np

    gram = bits @ (1 - bits).T
    return np.rint(gram + gram.T).astype(np.uint8)


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up with a sum of distance - m + 1 and the least total of costs[i][t + 1], by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                new = (cost + row[t + 1], [*chosen, t])
                if used + t not in grown or new < grown[used + t]:
                    grown[used + t] = new
        best = grown
    return best[distance - len(costs) + 1]


def choose_partitions(sample: list[int], total: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, for total fingerprints of which sample is a part. Near copies in
    the sample do not count: they meet under any partitions, and hot keys take care of them."""
    import numpy as np
    from math import comb

    bits = np.unpackbits(np.array(sample, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32) if sample else np.zeros((0, BITS), np.float32)
    others = np.triu(_distances(bits) > 2 * distance, 1)
    all_pairs = len(bits) * (len(bits) - 1) / 2
    total = max(total, 1000)  # of few nodes, any partitions do
    pairs = total * (total - 1) / 2
    found = []
    for m in range(2, distance + 2):
        groups = _groups(bits, m) if len(bits) > 1 else [list(range(k, BITS, m)) for k in range(m)]
        costs = []
        for g in groups:
            apart = _distances(bits[:, g])[others]
            row = [0.0]
            for t in range(distance + 1):
                ball, probes = (sum(comb(len(g), k) for k in range(r + 1)) for r in (t, (t + 1) // 2))
                # a sample is too small to see rare collisions: they are no rarer than between random bits
                share = max(np.count_nonzero(apart <= t) / max(all_pairs, 1), ball / 2.0 ** len(g))
                row.append(share * pairs + PROBE_COST * probes * total)
            costs.append(row)
        cost, chosen = allocate(costs, distance)
        found.append((cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _ball(bits: list[int], radius: int) -> list[int]:
    """Masks of all ways to flip at most radius of the bits, the one that flips none first."""
    return [_mask(list(c)) for n in range(radius + 1) for c in combinations(bits, n)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _near_values(part: int, value: Column, flips: list[int]) -> Column:
    """Array of (key, flips, part) of the partition's values that the flips make of value; flips: in how many bits they differ."""
    key = lambda f: F.struct(F.xxhash64(F.lit(part), value.bitwiseXOR(f)).alias("key"), F.bit_count(f).cast("byte").alias("flips"), F.lit(part).alias("part"))
    # one constant, as plans with a literal for each of them take the driver's memory
    return F.transform(F.split(F.lit(",".join(map(str, flips))), ",").cast("array<bigint>"), key)


def _probes(parts: list[tuple[list[int], int]]) -> Column:
    """Array of (key, flips, part) of a fingerprint fp: the values within half of each partition's threshold, rounded up.
    Two fingerprints within the threshold meet half way: one goes half of their distance, rounded down, the other the rest."""
    return F.concat(*(_near_values(k, F.col("fp").bitwiseAND(F.lit(_mask(bits))), _ball(bits, (t + 1) // 2)) for k, (bits, t) in enumerate(parts)))


def _hot_keys(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Keys under which many meet. Only values that several fingerprints share count: the others add a few to each key."""
    values = F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("value")) for k, (bits, _) in enumerate(parts)))
    shared = nodes.select(F.explode(values).alias("x")).groupBy("x.part", "x.value").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED)
    around = None
    for k, (bits, t) in enumerate(parts):
        keys = shared.where(F.col("part") == k).select("n", F.explode(_near_values(k, F.col("value"), _ball(bits, (t + 1) // 2))).alias("x")).select("n", "x.key")
        around = keys if around is None else around.unionByName(keys)
    return around.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > BUCKET).select("key")


def _first_part(parts: list[tuple[list[int], int]]) -> str:
    """Whether a_part is the first partition in which the fingerprints a_fp and b_fp are within its threshold."""
    return " AND ".join(f"(a_part <= {k} OR bit_count((a_fp ^ b_fp) & {_mask(bits)}L) > {t})" for k, (bits, t) in enumerate(parts))


def _half_way(parts: list[tuple[list[int], int]]) -> str:
    """Whether a and b meet under a key that lies between their values, the lesser node not farther from it: of all keys
    that both probe, these are one for distances of 0 and 1, two for 2. Which they are does not depend on which is a."""
    of_part = lambda values: f"CASE a_part {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(values))} END"
    apart = f"bit_count((a_fp ^ b_fp) & {of_part(f'{_mask(bits)}L' for bits, _ in parts)})"
    return f"a_flips + b_flips = {apart} AND if(a_node < b_node, a_flips, b_flips) = {apart} div 2 AND {apart} <= {of_part(t for _, t in parts)}"


def _pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def near_links(nodes: DataFrame, distance: int = DISTANCE, verify: Callable[[DataFrame], DataFrame] | None = None, sketches: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """u, v long: pairs of nodes whose fingerprints differ in at most distance bits and that verify keeps, enough of them
    to connect all that such pairs connect. nodes: node (distinct), fp long, in a written table. sketches gives node, n and
    sketch of some nodes; verify must keep no pair that may_be_similar leaves out.

    Under a key of few nodes, all are compared. Under others, all are first compared to one of them, or some where there are
    sketches; then those that are not of the component that most of the key's nodes have got are compared to the rest, if
    their sketches allow it, and where that is very much only if they also agree in one of distance + 1 pieces of the bits.
    A pair is made in the first partition and piece in which it meets, under a key half way. So a group of near copies
    costs about a comparison a node and key, not one a pair, and nothing is left out.
    """
    verify = verify or (lambda pairs: pairs)
    sample = [r[0] for r in nodes.orderBy(F.xxhash64("fp"), "node").limit(SAMPLE).select("fp").collect()]
    parts = choose_partitions(sample, EXPECTED, distance)
    keyed = nodes.select("node", "fp", F.explode(_probes(parts)).alias("x")).select("node", "fp", "x.*")
    as_ = lambda df, a: df.select("key", *(F.col(c).alias(f"{a}_{c}") for c in df.columns if c != "key"))
    close = F.expr(f"bit_count(a_fp ^ b_fp) <= {distance}")
    if sketches:
        close = close & may_be_similar("a", "b")

    once = f"{_half_way(parts)} AND {_first_part(parts)}"
    hot = materialize(_hot_keys(nodes, parts), "hot-keys")
    n_hot = hot.count()
    cold = keyed
    if n_hot:
        few = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        cold = keyed.join(few, "key", "left_anti")
    # Spark sizes probes as if each node made one, so it would broadcast all of them where the nodes alone are small
    pairs = as_(cold, "a").hint("merge").join(as_(cold, "b"), "key").where("a_node < b_node").where(f"bit_count(a_fp ^ b_fp) <= {distance}").where(once)
    links = materialize(verify(materialize(pairs.select(F.col("a_node").alias("u"), F.col("b_node").alias("v")).distinct(), "pairs")), "links")
    if not n_hot:
        return links

    met = materialize(keyed.join(few, "key", "left_semi"), "met")
    if sketches:
        drawn = materialize(sketches(met.select("node").distinct()), "sketches")
        met = materialize(not_guessed(met).join(not_guessed(drawn), "node"), "met")
    # those that are nearest to the majority of a key's bits: where copies were each changed on their own, the original
    ones = [F.sum(F.shiftright("fp", i).bitwiseAND(F.lit(1))).alias(f"_{i}") for i in range(BITS)]
    middle = met.groupBy("key").agg(F.count("*").alias("_n"), *ones)
    middle = middle.select("key", sum((F.when(2 * F.col(f"_{i}") > F.col("_n"), F.lit(_mask([i]))).otherwise(0) for i in range(1, BITS)), F.when(2 * F.col("_0") > F.col("_n"), F.lit(1)).otherwise(F.lit(0)).cast("long")).alias("middle"))
    told = ["node", "fp", *(["n", "sketch"] if sketches else [])]
    order = F.struct(F.expr("bit_count(fp ^ middle)").alias("far"), F.xxhash64("node").alias("h"), *told)
    spot = F.pmod(F.xxhash64("node"), F.lit(PIVOTS if sketches else 1)).alias("spot")
    pivots = met.join(F.broadcast(middle) if n_hot <= BROADCAST_KEYS else middle, "key").groupBy("key", spot).agg(F.min(order).alias("b")).select("key", *(F.col(f"b.{c}").alias(f"b_{c}") for c in told))
    pivots = F.broadcast(pivots) if n_hot <= BROADCAST_KEYS else pivots
    first = as_(met, "a").join(pivots, "key").where("a_node <> b_node").where(close)
    first = materialize(first.select(*_pair("a_node", "b_node")).distinct(), "pairs")
    links = links.unionByName(materialize(verify(first), "links"))

    # what the first comparisons leave apart
    roots = components(links)
    met = materialize(met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "met")
    main = met.groupBy("key", "root").agg(F.count("*").alias("_n")).groupBy("key").agg(F.max_by("root", F.struct("_n", "root")).alias("main"), F.sum("_n").alias("all"), F.max("_n").alias("most"))
    main = materialize(main.where("all > most").select("key", "main", ((F.col("all") - F.col("most")) * F.col("all")).alias("work")), "main")
    apart = met.join(F.broadcast(main) if n_hot <= BROADCAST_KEYS else main, "key").where("root <> main")
    n_met = met.count()

    def compared(some: DataFrame, others: DataFrame, once: str) -> DataFrame:
        both = as_(some, "a").join(not_guessed(as_(others, "b"), n_met), "key").where("a_root <> b_root AND (b_root = a_main OR a_node < b_node)")
        return both.where(close).where(once).select(*_pair("a_node", "b_node"))

    plain = 0 if sketches else PLAIN
    more = compared(apart.where(F.col("work") <= plain), met, once)
    if not main.where(F.col("work") > plain).isEmpty():
        crowd, others = apart.where(F.col("work") > plain), met
        large = main.where(F.col("work") > WHOLE).select("key", F.lit(True).alias("large"))
        if not large.isEmpty():
            piece = [_mask(list(range(p, BITS, distance + 1))) for p in range(distance + 1)]
            values = F.when(F.col("large"), F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in piece))).otherwise(F.array(F.lit(0).cast("long")))

            def split(rows: DataFrame) -> DataFrame:
                dealt = rows.join(F.broadcast(large) if n_hot <= BROADCAST_KEYS else large, "key", "left").select("*", F.posexplode(values).alias("piece", "value"))
                return dealt.withColumn("key", F.xxhash64("key", "piece", "value")).drop("value", "large")

            crowd, others = split(crowd), split(others)
            once += " AND " + " AND ".join(f"(a_piece <= {p} OR ((a_fp ^ b_fp) & {m}L) <> 0)" for p, m in enumerate(piece))
        crowd = compared(crowd, others, once)
        more = crowd if sketches else more.unionByName(crowd)
    more = materialize(more.distinct().join(not_guessed(first), ["u", "v"], "left_anti"), "pairs")
    return links if more.isEmpty() else links.unionByName(materialize(verify(more), "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row a document: its id, fingerprint (16 hex digits) and component_id, the smallest id reachable by links.

    Fingerprints link that differ in at most distance bits, equal ones included. Null and blank texts have fingerprint
    zero and link like any other. Null ids are kept; a group of them alone has a null component_id. Repeated rows stay
    repeated; ties don't matter, as the smallest id is one value. Other columns are left out. An empty table gives an
    empty result.
    """
    rows = materialize(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id"], "_text", shingle), "fp")
    # equal fingerprints are one node, so a text that fills a third of the rows costs one row a task
    # nulls sort first in a struct: the id is wanted, so they go last
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id")).alias("first")
    nodes = materialize(rows.groupBy("fp").agg(best, F.count("*").alias("n")).withColumn("node", F.col("fp")), "fingerprints")
    found = components(near_links(nodes.select("node", "fp"), distance))
    rooted = materialize(nodes.join(found, "node", "left").select("fp", "n", "first", F.coalesce("root", "node").alias("root")), "rooted")
    firsts = materialize(rooted.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("nodes")), "firsts")
    known = materialize(spread_join(rooted, firsts, "root", "nodes").select("fp", "n", F.col("least._id").alias("component_id")), "known")
    return spread_join(rows, known, "fp", "n").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes, shingle: int = VERIFY_SHINGLE):
    """The distinct 64-bit hashes of a text's word shingles, sorted; a shorter text is one shingle, a blank one has none."""
    import numpy as np

    return np.unique(np.concatenate([np.zeros(0, np.int64), *(h.view("<i8") for h in _shingle_hashes(text.lower().split(), shingle))]))


def sketch(hashes) -> bytes:
    """SKETCH bits of a set of hashes. Two sketches differ in no more bits than the sets do in members."""
    import numpy as np

    return np.packbits(np.bincount(hashes & (SKETCH - 1), minlength=SKETCH) & 1).tobytes()


def may_be_similar(x: str, y: str) -> Column:
    """Whether sets can have a Jaccard similarity of 0.8, by their sizes and sketches (columns x_n, x_sketch, ...).

    At 0.8 they differ in a ninth of their sizes' sum at most, and so do the sketches: no such pair is left out.
    """
    differ = " + ".join(f"bit_count({x}_sketch[{k}] ^ {y}_sketch[{k}])" for k in range(SKETCH // 64))
    return F.expr(f"9 * abs({x}_n - {y}_n) <= {x}_n + {y}_n AND 9 * ({differ}) <= {x}_n + {y}_n")


def _sets(it):
    import numpy as np
    import pyarrow as pa

    for b in it:
        made = [shingles(t) for t in b.column(1).to_pylist()]
        flat = np.concatenate([*made, np.zeros(0, np.int64)])
        hashes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(flat, pa.int64()))
        bits = np.frombuffer(b"".join(map(sketch, made)), "<i8")
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * (SKETCH // 64), pa.int32()), pa.array(bits, pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), hashes, pa.array(map(len, made), pa.int64()), bits], ["node", "hashes", "n", "sketch"])


def _names(shingle: int):
    """A 128-bit name of a text's words, and its fingerprint, beside the carried columns."""

    def batches(it):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        release()
        for b in it:
            texts = [t.lower().split() for t in b.column(b.num_columns - 1).to_pylist()]
            name = np.frombuffer(b"".join(xxh3_128_digest(b" ".join(w)) for w in texts), "<i8").reshape(-1, 2)
            fp = [_majority(_shingle_hashes(list(set(w)) if shingle == 1 else w, shingle)) for w in texts]
            made = [pa.array(np.ascontiguousarray(name[:, 0])), pa.array(np.ascontiguousarray(name[:, 1])), pa.array(fp, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "name1", "name2", "fp"])

    return batches


def _row_hashes(docs: DataFrame) -> dict[str, Column]:
    """128 bits that name a row by all its columns; equal rows are named alike."""
    columns = [F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else F.col(c) for c, kind in ((f"`{c}`", kind) for c, kind in docs.dtypes)]
    nulls = [F.isnull(f"`{c}`") for c in docs.columns]  # a null leaves a hash as it was
    return {f"_r{k}": F.xxhash64(F.lit(k), *nulls, *columns) for k in (1, 2)}


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = WORD_DISTANCE) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest id, and one of its repeats.

    Documents link whose sets of 5-word shingles (words lower-cased in A-Z, divided by ASCII white space) have a Jaccard
    similarity of 0.8 at least. Candidates are texts whose fingerprints over their distinct words differ in at most
    distance bits, and each is verified on the whole sets. Texts of the same words in the same order always link; null
    and blank texts are alike; a text of fewer words is one shingle. Null ids come after all others. Rows that are equal
    in all columns are one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    # packed, so that no name among its columns meets one of ours
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("_doc"), *(h.alias(c) for c, h in _row_hashes(docs).items()))
    text = F.coalesce(F.col(f"_doc.`{text_col}`"), F.lit("")).cast("binary")
    light = rows.select(F.col(f"_doc.`{id_col}`").alias("_id"), "_r1", "_r2", text.alias("_text"))
    named = light.mapInArrow(_names(1), f"_id {light.schema['_id'].dataType.simpleString()}, _r1 long, _r2 long, name1 long, name2 long, fp long")
    named = materialize(named, "names")
    best = named.groupBy("name1", "name2").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_r1", "_r2")).alias("first"), F.any_value("fp").alias("fp"))
    nodes = materialize(best.withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts = rows.select("_r1", "_r2", text.alias("_text"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = materialize(wanted.join(nodes, "node").select("node", "first._r1", "first._r2"), "wanted")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted.hint("merge")
        some = texts.join(wanted, ["_r1", "_r2"]).select("node", "_text")
        sets = some.mapInArrow(_sets, "node long, hashes array<long>, n long, sketch array<long>").groupBy("node")
        return sets.agg(*(F.any_value(c).alias(c) for c in ("hashes", "n", "sketch")))  # equal rows are one

    def similar(pairs: DataFrame) -> DataFrame:
        sets = materialize(sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()), "sets")
        small = F.broadcast if sets.count() <= BROADCAST_SKETCHES else lambda df: df.hint("merge")
        for side in ("u", "v"):
            pairs = pairs.join(small(sets.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch"))), side)
        pairs = materialize(pairs.where(may_be_similar("u", "v")).select("u", "v"), "likely")
        whole = sets.select("node", "hashes").hint("merge")  # few rows can be much, and copies' sets are small in files
        both = pairs.join(whole.select(F.col("node").alias("u"), F.col("hashes").alias("x")), "u").join(whole.select(F.col("node").alias("v"), F.col("hashes").alias("y")), "v")
        return both.where("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))").select("u", "v")

    roots = components(near_links(nodes.select("node", "fp"), distance, similar, lambda some: sets_of(some).select("node", "n", "sketch")))
    rooted = nodes.select("node", "first").join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first._r1", "first._r2")
    # of each kept name, how many rows have it; the other rows go
    names = named.groupBy("_r1", "_r2").agg(F.count("*").alias("n")).join(kept.withColumn("_kept", F.lit(True)), ["_r1", "_r2"], "left")
    names = materialize(names.select("_r1", "_r2", "n", F.coalesce("_kept", F.lit(False)).alias("_kept")), "kept")
    gone, again = names.where("NOT _kept").select("_r1", "_r2"), names.where("_kept AND n > 1").select("_r1", "_r2")
    bounded = lambda df: F.broadcast(df) if df.count() <= BROADCAST_KEYS else df
    out = rows.join(bounded(gone), ["_r1", "_r2"], "left_anti")
    if not again.isEmpty():
        again = bounded(again)
        once = out.join(again, ["_r1", "_r2"], "left_semi").groupBy("_r1", "_r2").agg(F.any_value("_doc").alias("_doc"))
        out = out.join(again, ["_r1", "_r2"], "left_anti").select("_doc").unionByName(once.select("_doc"))
    return out.select("_doc.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
