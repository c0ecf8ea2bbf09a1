"""Matching entities across sources without keys: a regularised Gaussian mixture over similarity vectors.

Candidate pairs come from a cell join (a reach is looked for within a bounded distance of an outlet). Each pair has a
vector of similarities, any of which may be missing. Gaussians of unmatched and of matched pairs are fitted without
labels by expectation maximisation over all pairs; variances are shrunk towards the pooled ones. Matched pairs have
two: positions are mostly good, and a few are far off though all else agrees.

Transitivity binds in every expectation step. Reaches are distinct, so an outlet cannot match two of them: its belief
is divided among its candidates and none of them. And one site comes under several ids, so outlets that stand on one
spot are linked: what the others of the spot believe of a reach enters an outlet's belief, by as much as such
neighbours agree at all, which the data tell. Beliefs of a spot are added up per reach, so no pair of outlets is ever
listed. The result is a posterior per pair.

The pairs are written once, grouped by outlet (and again with what their neighbours believe); a step reads them, adds
up sufficient statistics next to the data and returns a single row of numbers.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from thalweg.functions.geometry import segment_distance
from thalweg.session import materialise

#: Farthest distance of a candidate, in degrees.
MAX_DEGREES = 0.1
#: Similarities of a pair, in order.
FEATURES = ("near", "area", "name")
#: Components of the mixture.
PARTS = 3
#: Share of the pooled variance mixed into each component's, and the least variance.
SHRINK = 0.05
LEAST_VARIANCE = 4e-4
#: Steps stop when no mean moves by more than this (and no weight by ten times this part); a warning says if they ran out.
TOLERANCE = 1e-3
MAX_STEPS = 100
#: Edge in degrees of a spot, and how often beliefs pass between its outlets.
SPOT_DEGREES = 0.005
SITE_ROUNDS = 1

_ACCENTED = "áàâäãåéèêëíìîïóòôöõøúùûüýñçþðæœß"
_PLAIN = "aaaaaaeeeeiiiioooooouuuuynctdaos"


def folded(name: Column) -> Column:
    return F.translate(F.lower(name), _ACCENTED, _PLAIN)


def name_words(name: Column) -> Column:
    """Folded words of a station's name, and neighbouring words run together; null of null."""
    words = F.filter(F.split(folded(name), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    joined = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.concat(words, F.filter(joined, lambda w: w.isNotNull())))


def river_word(river: Column) -> Column:
    """A river's name as one folded word; null where nothing is left."""
    return F.nullif(F.regexp_replace(folded(river), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def word_similarity(words: Column, target: Column, letters: Column) -> Column:
    """Best similarity of any word to the target: 1 less edits per letter, two letters that changed places being one.

    letters are the target's, sorted. Words whose length differs by more than half of the target's are not compared;
    if no other is left, the similarity is 0. Null if there is no word or no target.
    """
    near = F.filter(words, lambda w: F.abs(F.length(w) - F.length(target)) * 2 <= F.length(target))
    counted = F.transform(near, lambda w: F.struct(w.alias("w"), F.levenshtein(w, target).alias("n")))

    def alike(e: Column) -> Column:
        swapped = (e["n"] == 2) & (F.array_sort(F.split(e["w"], "")) == letters)
        return 1 - F.when(swapped, 1).otherwise(e["n"]) / F.greatest(F.length(e["w"]), F.length(target))

    best = F.coalesce(F.array_max(F.transform(counted, alike)), F.lit(0.0))
    return F.when((F.size(words) > 0) & target.isNotNull(), F.when(F.array_contains(words, target), F.lit(1.0)).otherwise(best))


def name_similarity(name: Column, river: Column) -> Column:
    """Similarity of a station's name to a river's; null if either is."""
    target = river_word(river)
    return word_similarity(name_words(name), target, F.array_sort(F.split(target, "")))


def area_similarity(a: Column, b: Column) -> Column:
    """The smaller area over the larger; null unless both are positive numbers."""
    good = (a > 0) & (b > 0) & ~F.isnan(a) & ~F.isnan(b)
    return F.when(good, F.least(a, b) / F.greatest(a, b))


def one_per_outlet(outlets: DataFrame) -> DataFrame:
    """(id, lat, lng, name, area): repeated rows of an id become one, each value the first known by rec_no.

    Rows without a rec_no come last; rows with the same one are taken in the order of their values.
    """
    order = F.coalesce(F.col("rec_no"), F.lit(2**63 - 1))

    def first(*cols: str) -> Column:
        known = F.lit(True)
        for c in cols:
            known = known & F.col(c).isNotNull()
        return F.min(F.when(known, F.struct(order.alias("_order"), *cols)))

    known = outlets.where(F.col("id").isNotNull())
    one = known.groupBy("id").agg(first("lat", "lng").alias("_spot"), first("name").alias("_name"), first("area").alias("_area"))
    return one.select("id", "_spot.lat", "_spot.lng", "_name.name", "_area.area")


def one_per_reach(rivers: DataFrame) -> DataFrame:
    """(comid, uparea, riv_name): repeated rows become one; a repeat may lack a value."""
    return rivers.where(F.col("comid").isNotNull()).groupBy("comid").agg(F.max("uparea").alias("uparea"), F.max("riv_name").alias("riv_name"))


def segments(rivers: DataFrame) -> DataFrame:
    """(comid, x1, y1, x2, y2): the pieces of every reach's line; a line of one point is a piece of no length.

    Lines with missing numbers or unequal counts have none. A piece across the date line runs on beyond 180 degrees.
    """
    whole = (F.size("line_lng") == F.size("line_lat")) & (F.size("line_lng") > 0)
    for c in ("line_lng", "line_lat"):
        whole = whole & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v))
    at = rivers.where(F.col("comid").isNotNull() & whole).select("comid", "line_lng", "line_lat", F.explode(F.sequence(F.lit(0), F.greatest(F.size("line_lng") - 2, F.lit(0)))).alias("i"))
    ends = {n: F.get(c, F.col("i") + k) for n, c, k in (("x1", "line_lng", 0), ("y1", "line_lat", 0), ("x2", "line_lng", 1), ("y2", "line_lat", 1))}
    e = at.select("comid", *[v.alias(n) for n, v in ends.items()])
    e = e.withColumns({"x2": F.coalesce("x2", "x1"), "y2": F.coalesce("y2", "y1")})
    apart = F.col("x2") - F.col("x1")
    return e.withColumn("x2", F.col("x2") - F.when(apart > 180, 360.0).when(apart < -180, -360.0).otherwise(0.0))


def candidates(outlets: DataFrame, rivers: DataFrame, max_degrees: float = MAX_DEGREES) -> DataFrame:
    """(id, comid, spot, n_spot, near, area, name): similarities of every outlet and reach within the distance.

    near falls from 1 on the line to 0 at the distance. Outlets without a position have no candidates. n_spot is the
    number of outlets on the same spot. An outlet's name and area stay where they are: pairs go to them once, by id.
    """
    o = one_per_outlet(outlets).where(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180))
    cell = lambda c: F.floor(c / F.lit(2 * max_degrees))
    cells = lambda a, b: F.explode(F.sequence(cell(a), cell(b)))
    # an outlet by the date line stands on both sides of it, and looks into the four cells around
    west, east = F.when(F.col("lng") + max_degrees > 180, F.col("lng") - 360), F.when(F.col("lng") - max_degrees < -180, F.col("lng") + 360)
    probe = o.select("id", F.col("lat").alias("py"), F.explode(F.array_compact(F.array("lng", west, east))).alias("px"))
    probe = probe.withColumn("cx", cells(F.col("px") - max_degrees, F.col("px") + max_degrees)).withColumn("cy", cells(F.col("py") - max_degrees, F.col("py") + max_degrees))
    # a piece lies in the cells that its box meets
    reach = one_per_reach(rivers).select("comid", F.col("uparea").alias("_up"), river_word(F.col("riv_name")).alias("_river"))
    lines = segments(rivers).join(reach, "comid")
    lines = lines.withColumn("cx", cells(F.least("x1", "x2"), F.greatest("x1", "x2"))).withColumn("cy", cells(F.least("y1", "y2"), F.greatest("y1", "y2")))
    box = F.col("px").between(F.least("x1", "x2") - max_degrees, F.greatest("x1", "x2") + max_degrees) & F.col("py").between(F.least("y1", "y2") - max_degrees, F.greatest("y1", "y2") + max_degrees)
    d = segment_distance(*[F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2")])
    hits = probe.join(lines, ["cx", "cy"]).where(box).select("id", "comid", d.alias("d"), "_up", "_river").where(F.col("d") <= max_degrees)
    # one exchange of the pairs: what follows is by id
    near = hits.repartition("id").groupBy("id", "comid", "_up", "_river").agg(F.min("d").alias("d"))  # a reach has one area and name
    spot = F.struct(F.round(F.col("lng") / SPOT_DEGREES).cast("long").alias("x"), F.round(F.col("lat") / SPOT_DEGREES).cast("long").alias("y"))
    o = o.withColumn("spot", spot)
    place = o.join(o.groupBy("spot").agg(F.count(F.lit(1)).alias("n_spot")), "spot").select("id", "spot", "n_spot", "area", name_words(F.col("name")).alias("_words"))
    return near.join(place, "id").select(
        "id",
        "comid",
        "spot",
        "n_spot",
        (1 - F.col("d") / max_degrees).alias("near"),
        area_similarity(F.col("area"), F.col("_up")).alias("area"),
        word_similarity(F.col("_words"), F.col("_river"), F.array_sort(F.split("_river", ""))).alias("name"),
    )


def _powers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """1, value and square of each similarity; all 0 where it is missing."""
    missing = np.isnan(x)
    v = np.where(missing, 0.0, x)
    return (~missing).astype(float), v, v * v


@dataclass(frozen=True)
class Mixture:
    """weights, means and variances of the components: unmatched, matched, matched with a position far off."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of each row under each component; a missing similarity (nan) says nothing."""
        known, v, squares = _powers(x)
        m, s = self.means.T, self.variances.T
        return known @ (-0.5 * (m * m / s + np.log(s))) + v @ (m / s) + squares @ (-0.5 / s) + np.log(self.weights)

    def odds(self, logs: np.ndarray) -> np.ndarray:
        """Log odds of match against no match."""
        return np.logaddexp(logs[:, 1], logs[:, 2]) - logs[:, 0]

    def beliefs(self, x: np.ndarray, boost: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Responsibilities of the components, at most one candidate of a group matching; boost: of its neighbours."""
        logs = self.logs(x)
        p = posteriors(self.odds(logs) + boost, starts)
        close = p / (1 + np.exp(np.clip(logs[:, 2] - logs[:, 1], -50, 50)))
        return np.stack([1 - p, close, p - close], axis=1)


def posteriors(odds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Posterior of each candidate when at most one of its group (rows from starts[k] on) can match."""
    if not len(odds):
        return odds
    sizes = np.diff(np.append(starts, len(odds)))
    top = np.maximum(np.maximum.reduceat(odds, starts), 0.0)
    e = np.exp(odds - np.repeat(top, sizes))
    return e / np.repeat(np.add.reduceat(e, starts) + np.exp(-top), sizes)


def _start(x: np.ndarray) -> np.ndarray:
    """First belief: near and alike in whatever else is known, or farther off and alike in everything."""
    near, area, name = x.T
    close = (near >= 0.8) & ~(area < 0.85) & ~(name < 0.8) & ~(np.isnan(area) & np.isnan(name))
    off = (near < 0.8) & (area >= 0.95) & (name >= 0.95)
    out = np.where(close[:, None], [0.02, 0.97, 0.01], np.where(off[:, None], [0.7, 0.01, 0.29], [0.985, 0.01, 0.005]))
    return out


def _packed(x: np.ndarray, starts: np.ndarray, rows: int) -> pa.Array:
    """A row of bytes per outlet: its candidates' similarities and boosts, in single precision. Steps read nothing else."""
    offsets = np.append(starts, len(x)).astype(np.int32) * (x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(x, np.float32).tobytes())])


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(similarities, boosts, offsets of the outlets' candidates)."""
    cells = batch.column(batch.schema.get_field_index("x"))
    offsets = np.frombuffer(cells.buffers()[1], np.int32, len(cells) + 1, cells.offset * 4).astype(np.int64)
    width = len(FEATURES) + 1
    x = np.frombuffer(cells.buffers()[2], np.float32, (offsets[-1] - offsets[0]) // 4, offsets[0]).reshape(-1, width).astype(float)
    return x[:, :-1], x[:, -1], (offsets - offsets[0]) // (4 * width)


def _pack_groups(batches):
    for batch in batches:
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        x = np.column_stack([flat.field(f).to_numpy(zero_copy_only=False).astype(float) for f in FEATURES] + [np.zeros(len(flat))])
        comids = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), flat.field("comid"))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], comids, _packed(x, offsets[:-1] - offsets[0], batch.num_rows)], ["id", "spot", "n_spot", "comids", "x"])


def _boost_groups(batches):
    """(id, spot, n_spot, comids, x, boosts) with the boosts, in the order of the candidates, put in."""
    for batch in batches:
        if batch.num_rows:
            x, _, offsets = _unpack(batch)
            boosts = batch.column(5)
            values = boosts.values.slice(boosts.offsets[0].as_py(), len(x)).to_numpy(zero_copy_only=False)
            again = _packed(np.column_stack([x, values]), offsets[:-1], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], again], ["id", "spot", "n_spot", "comids", "x"])


def _statistics(mixture: Mixture | None, first):
    n = len(FEATURES)

    def run(batches):
        total = np.zeros((PARTS, n, 3))
        count = np.zeros(PARTS)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, boost, offsets = _unpack(batch)
            g = first(x) if mixture is None else mixture.beliefs(x, boost, offsets[:-1])
            total += np.stack([g.T @ p for p in _powers(x)], axis=2)
            count += g.sum(axis=0)
        row = [*count, *total.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i in range(len(row))], pa.int32()), pa.array(row, pa.float64())], ["i", "v"])

    return run


@dataclass(frozen=True)
class Fit:
    """The mixture (None if there are no pairs), the steps taken, and whether the last one still moved it."""

    mixture: Mixture | None
    steps: int
    converged: bool


def _maximise(count: np.ndarray, t: np.ndarray) -> Mixture:
    """The regularised mixture of sums: per component and similarity its weight, weighted values and their squares."""
    pooled_total = t.sum(axis=0)
    t = t.copy()
    t[1:, 1:] = t[1:, 1:].sum(axis=0)  # matches agree in area and name alike, wherever their position lies
    pooled_n = np.maximum(pooled_total[:, 0], 1e-9)
    pooled_mean = pooled_total[:, 1] / pooled_n
    pooled = np.maximum(pooled_total[:, 2] / pooled_n - pooled_mean**2, LEAST_VARIANCE)
    seen = np.maximum(t[:, :, 0], 1e-9)
    means = np.where(t[:, :, 0] > 1e-6, t[:, :, 1] / seen, pooled_mean)
    own = np.where(t[:, :, 0] > 1e-6, t[:, :, 2] / seen - means**2, pooled)
    variances = np.maximum((1 - SHRINK) * np.maximum(own, 0) + SHRINK * pooled, LEAST_VARIANCE)
    return Mixture(np.maximum(count / count.sum(), 1e-6), means, variances)


def fit(groups: DataFrame, steps: int = MAX_STEPS, mixture: Mixture | None = None, first=_start, tolerance: float = TOLERANCE) -> Fit:
    """Expectation maximisation over all pairs, from `mixture` or else from the beliefs `first` gives. A step moves
    one row to the driver."""
    n = len(FEATURES)
    for step in range(1, steps + 1):
        rows = groups.select("x").mapInArrow(_statistics(mixture, first), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(PARTS + PARTS * n * 3)
        for r in rows:
            flat[r["i"]] = r["v"]
        count, t = flat[:PARTS], flat[PARTS:].reshape(PARTS, n, 3)
        if count.sum() == 0:
            return Fit(None, step, True)
        new = _maximise(count, t)
        done = mixture is not None and np.abs(new.weights / mixture.weights - 1).max() < tolerance * 10 and np.abs(new.means - mixture.means).max() < tolerance
        mixture = new
        if done:
            return Fit(mixture, step, True)
    return Fit(mixture, steps, False)


def _believe(mixture: Mixture | None, id_type: pa.DataType, spot_type: pa.DataType, key_type: pa.DataType):
    def run(batches):
        for batch in batches:
            if not batch.num_rows or mixture is None:
                continue
            x, boost, offsets = _unpack(batch)
            p = posteriors(mixture.odds(mixture.logs(x)) + boost, offsets[:-1])
            lists = batch.column(2)
            comids = lists.values.slice(lists.offsets[0].as_py(), len(p))
            owner = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(offsets)))
            total = np.repeat(np.add.reduceat(p, offsets[:-1]), np.diff(offsets))
            data = [batch.column(0).cast(id_type).take(owner), batch.column(1).cast(spot_type).take(owner), comids.cast(key_type), pa.array(p), pa.array(total)]
            yield pa.RecordBatch.from_arrays(data, ["id", "spot", "comid", "confidence", "any_match"])

    return run


def _believed(groups: DataFrame, mixture: Mixture | None) -> DataFrame:
    """(id, spot, comid, confidence, any_match) of every pair."""
    kinds = dict(groups.dtypes)
    comid = groups.schema["comids"].dataType.elementType
    types = [to_arrow_type(groups.schema[c].dataType) for c in ("id", "spot")] + [to_arrow_type(comid)]
    schema = f"id {kinds['id']}, spot {kinds['spot']}, comid {comid.simpleString()}, confidence double, any_match double"
    return groups.select("id", "spot", "comids", "x").mapInArrow(_believe(mixture, *types), schema)


def _with_neighbours(groups: DataFrame, mixture: Mixture) -> DataFrame:
    """The groups with boosts: for each candidate, how much likelier the other outlets on the spot make it.

    A neighbour shares an outlet's reach with a probability that is measured, over all spots with several outlets, as
    the part of neighbours believed to; with it, what the neighbours believe replaces an even prior. Only outlets that
    have neighbours are written again.
    """
    linked = groups.where("n_spot > 1")
    scored = materialise(_believed(linked, mixture).select("id", "spot", "comid", "confidence"), "beliefs")
    per = scored.groupBy("spot", "comid").agg(F.sum("confidence").alias("s"), F.sum(F.col("confidence") ** 2).alias("q"))
    agree = per.agg(F.sum(F.col("s") ** 2 - F.col("q"))).first()[0]
    among = linked.agg(F.sum(F.col("n_spot") - 1)).first()[0]
    rho = min(0.9, max(0.0, (agree or 0.0) / among)) if among else 0.0
    if rho == 0.0:
        return groups
    pairs = scored.join(per.select("spot", "comid", "s"), ["spot", "comid"]).join(linked.select("id", "n_spot", F.size("comids").alias("k")), "id")
    others = F.greatest(F.lit(0.0), F.col("s") - F.col("confidence")) / (F.col("n_spot") - 1)
    boost = F.ln((1 - rho) + F.lit(rho) * others * F.col("k"))
    boosts = pairs.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("comid", boost.alias("b")))), lambda e: e["b"]).alias("boosts"))
    again = linked.join(boosts, "id").select(*groups.columns, "boosts").mapInArrow(_boost_groups, groups.schema)
    return groups.where("n_spot = 1").unionByName(materialise(again, "match-candidates"))


def _grouped(pairs: DataFrame) -> DataFrame:
    """(id, spot, n_spot, comids, x): an outlet's candidates in order, of which there are as many as reaches within the
    distance, and their similarities, packed."""
    kinds = dict(pairs.dtypes)
    groups = pairs.groupBy("id", "spot", "n_spot").agg(F.sort_array(F.collect_list(F.struct("comid", *FEATURES))).alias("c"))
    schema = f"id {kinds['id']}, spot {kinds['spot']}, n_spot long, comids array<{kinds['comid']}>, x binary"
    return materialise(groups.mapInArrow(_pack_groups, schema), "match-candidates")


def match_outlets(outlets: DataFrame, rivers: DataFrame, max_degrees: float = MAX_DEGREES, steps: int = MAX_STEPS) -> DataFrame:
    """(id, comid, confidence, any_match): posterior of every candidate pair, and per outlet that any of them holds.

    Outlets without id or position and reaches without comid or a whole line take no part; any other value may be null.
    Repeated rows are one. Empty tables give an empty result; other columns are ignored, whatever their names. A
    warning says if the mixture still moved after `steps` steps.
    """
    groups = _grouped(candidates(outlets, rivers, max_degrees))
    found = fit(groups, steps)
    for _ in range(SITE_ROUNDS if found.mixture is not None else 0):
        groups = _with_neighbours(groups, found.mixture)
        found = fit(groups, steps, found.mixture)
    if not found.converged:
        warnings.warn(f"the mixture still moved after {steps} steps", stacklevel=2)
    return _believed(groups, found.mixture).drop("spot")


def best_matches(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, comid, confidence): outlets that match some reach at `least` or better, with the likeliest one.

    Of equally likely reaches the one with the smaller comid is taken.
    """
    top = F.max(F.struct("confidence", (-F.col("comid")).alias("k")))
    best = scored.where(F.col("any_match") >= least).groupBy("id").agg(top.alias("t"))
    return best.select("id", (-F.col("t.k")).alias("comid"), F.col("t.confidence").alias("confidence"))
