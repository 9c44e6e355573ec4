"""Validation of certificates by expressions alone, independent of the kernels.

Each check returns the offending keys (g6, reason); an empty frame is a pass. A certificate
is a row together with its graph, so each is checked within its row, by arrays: nothing is
joined or sent to the driver, and only offenders are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from rotagraph.sources.graph6 import edge_array, order_of


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, where ``value`` is computed once however often ``f`` reads it."""
    return F.transform(F.array(value), f)[0]


def _code(a: Column, b: Column) -> Column:
    """A pair of vertices as a * 2^31 + b."""
    return F.shiftleft(a.cast("long"), 31) + b


def _starts(sorted_: Column, key: Callable[[Column], Column]) -> Column:
    """Where the runs of equal keys begin in a sorted array."""
    places = F.when(F.size(sorted_) > 0, F.sequence(F.lit(0), F.size(sorted_) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | ~key(F.get(sorted_, i)).eqNullSafe(key(F.get(sorted_, i - 1))))


def _runs(sorted_: Column, key: Callable[[Column], Column], f: Callable[[Column, Column], Column]) -> Column:
    """``f(start, length)`` of each run of equal keys in a sorted array."""
    return _with(_starts(sorted_, key), lambda starts: F.transform(starts, lambda s, j: f(s, F.coalesce(F.get(starts, j + 1), F.size(sorted_)) - s)))


def _near(edges: Column, n: Column) -> Column:
    """The neighbours of every vertex 0..n-1, with the vertex itself; edges beyond are left out."""
    vertices = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    inside = F.filter(edges, lambda e: e["u"].between(0, n - 1) & e["v"].between(0, n - 1))
    ends = F.concat(
        F.transform(inside, lambda e: F.struct(e["u"].alias("a"), e["v"].alias("b"))),
        F.transform(inside, lambda e: F.struct(e["v"].alias("a"), e["u"].alias("b"))),
        F.transform(vertices, lambda v: F.struct(v.alias("a"), v.alias("b"))),
    )
    return _with(F.sort_array(ends), lambda all_: _runs(all_, lambda x: x["a"], lambda s, length: F.transform(F.slice(all_, s + 1, length), lambda x: x["b"])))


def _roots(near: Column) -> Column:
    """The least vertex of each vertex's component: labels jump until they stay."""

    def step(labels: Column) -> Column:
        least = F.transform(near, lambda ws: F.array_min(F.transform(ws, lambda w: F.get(labels, w))))
        new = _with(least, lambda l: F.transform(l, lambda r: F.least(r, F.get(l, r))))
        return _with(new, lambda x: F.struct(x.alias("labels"), (x == labels).alias("stay")))

    first = F.struct(F.transform(near, lambda _, v: v).alias("labels"), F.lit(False).alias("stay"))
    rounds = F.sequence(F.lit(0), F.size(near))
    return F.aggregate(rounds, first, lambda acc, _: F.when(acc["stay"], acc).otherwise(step(acc["labels"])))["labels"]


def _faces(turned: Column) -> Column:
    """The face of each arc, in ascending order of arcs, as the least place of its facial walk;
    ``turned``: (arc, to) of every arc, where both are the same arcs. The places of ``to`` are
    those of the sorted ones; pointer doubling, as many rounds as the number of arcs has
    binary digits."""
    onward = F.transform(F.sort_array(turned), lambda x, i: F.struct(x["to"].alias("to"), i.alias("from")))
    now = F.transform(F.sort_array(onward), lambda x, i: F.struct(x["from"].alias("to"), i.alias("face")))
    ahead = lambda acc, x: F.get(acc, x["to"])
    doubled = lambda acc: F.transform(acc, lambda x: F.struct(ahead(acc, x)["to"].alias("to"), F.least(x["face"], ahead(acc, x)["face"]).alias("face")))
    rounds = F.sequence(F.lit(1), F.length(F.bin(F.size(turned).cast("long"))))
    return F.transform(F.aggregate(rounds, now, lambda acc, _: doubled(acc)), lambda x: x["face"])


def _all_on_outer_face(arcs: Column, faces: Column, roots: Column) -> Column:
    """Whether some walk of each component with edges visits all its vertices: the most that a
    walk visits, summed over components, is the number of vertices with edges."""
    source = lambda i: F.shiftright(F.get(arcs, i), 31).cast("int")
    visits = F.sort_array(F.array_distinct(F.transform(faces, lambda f, i: F.struct(f.alias("face"), source(i).alias("v")))))
    walks = _with(visits, lambda p: _runs(p, lambda x: x["face"], lambda s, length: F.struct(F.get(roots, F.get(p, s)["v"]).alias("root"), length.alias("visited"))))
    most = _with(F.sort_array(walks), lambda w: _runs(w, lambda x: x["root"], lambda s, length: F.get(w, s + length - 1)["visited"]))
    vertices = F.size(F.array_distinct(F.transform(arcs, lambda a: F.shiftright(a, 31))))
    return F.aggregate(most, F.lit(0), lambda acc, x: acc + x) == vertices


def _reasons(checks: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(wrong, F.lit(reason)) for reason, wrong in checks.items()]), lambda x: x.isNotNull())


def _offenders(decided: DataFrame, reasons: Column) -> DataFrame:
    return decided.select("g6", F.explode(reasons).alias("reason")).distinct()


def _embedding_reasons() -> Column:
    n, m, rotation = F.col("n"), F.col("m"), F.col("rotation")
    ring = lambda r: F.coalesce(r["nbrs"], F.array().cast("array<int>"))
    turned = F.flatten(F.transform(rotation, lambda r: F.transform(ring(r), lambda d, i: F.struct(_code(d, r["v"]).alias("arc"), _code(r["v"], F.get(ring(r), (i + 1) % F.size(ring(r)))).alias("to")))))
    edge = lambda a: _with(F.struct(F.shiftright(a, 31).alias("a"), a.bitwiseAND((1 << 31) - 1).alias("b")), lambda x: _code(F.least(x["a"], x["b"]), F.greatest(x["a"], x["b"])))

    def checks(edges: Column, turned: Column, arcs: Column, drawn: Column) -> Column:
        """``arcs``: ascending."""
        own = F.transform(edges, lambda e: _code(e["u"], e["v"]))
        paired = (F.size(arcs) == F.size(F.array_distinct(arcs))) & (arcs == F.sort_array(F.transform(turned, lambda x: x["arc"])))
        named = F.transform(rotation, lambda r: r["v"])

        def euler(near: Column, roots: Column, faces: Column) -> Column:
            components = F.size(F.array_distinct(roots))
            edge_components = F.size(F.filter(near, lambda ws, v: (F.get(roots, v) == v) & (F.size(ws) > 1)))
            return _reasons({
                "faces break the formula": F.size(F.array_distinct(faces)) - edge_components + 1 != m - n + 1 + components,
                "a vertex is not on the outer face": F.when(F.col("cmd") == "o", ~_all_on_outer_face(arcs, faces, roots)),
            })

        plain = _reasons({
            "an arc is no edge": F.size(F.array_except(drawn, own)) > 0,
            "arcs do not pair": (F.size(arcs) > 0) & ((F.size(arcs) != 2 * m) | ~paired),
            "an edge is missing": F.size(F.array_except(own, drawn)) > 0,
            "a vertex has two rings": F.size(named) != F.size(F.array_distinct(named)),
        })
        walked = _with(_near(edges, n), lambda near: _with(_roots(near), lambda roots: _with(_faces(turned), lambda faces: euler(near, roots, faces))))
        return F.concat(plain, walked)

    arcs = lambda t: F.sort_array(F.transform(t, lambda x: x["to"]))
    return _with(edge_array(F.col("g6")), lambda e: _with(turned, lambda t: _with(arcs(t), lambda a: _with(F.transform(a, edge), lambda d: checks(e, t, a, d)))))


def embedding_failures(decided: DataFrame) -> DataFrame:
    """Rotations that are not of their graph, or whose faces break Euler's formula; for the
    command o also those where a vertex misses the outer face (some walk of each component
    with edges must visit all its vertices)."""
    return _offenders(decided.where("rotation IS NOT NULL"), _embedding_reasons())


SHAPES = {"p": ["K5", "K3,3"], "d": ["K5", "K3,3"], "o": ["K4", "K2,3"], "2": ["K2,3"], "3": ["K3,3"], "4": ["K4"]}


def _kind(near: Column, marked: Column) -> Column:
    """(kind, covered): which homeomorph the edges ``marked`` are, null if none, and how many
    of them lie on its paths; ``near``: their neighbours, without the vertex itself."""
    is_branch = lambda v: ~F.size(F.get(near, v)).isin(0, 2)
    branches = F.filter(F.transform(near, lambda _, v: v), is_branch)
    degrees = F.array_join(F.sort_array(F.transform(branches, lambda v: F.size(F.get(near, v)))), "")

    def onward(acc: Column) -> Column:
        """An inner vertex (degree 2) goes on to its other neighbour."""
        ws = F.get(near, acc["t"])
        return F.when(F.size(ws) == 2, F.struct(acc["t"].alias("before"), (F.get(ws, F.lit(0)) + F.get(ws, F.lit(1)) - acc["before"]).alias("t"), (acc["length"] + 1).alias("length"))).otherwise(acc)

    def walk(s: Column, b: Column) -> Column:
        end = F.aggregate(marked, F.struct(s.alias("before"), b.alias("t"), F.lit(1).alias("length")), lambda acc, _: onward(acc))
        return _with(end, lambda x: F.struct(s.alias("s"), x["t"].alias("t"), x["length"].alias("length")))

    def judged(branches: Column, degrees: Column, walks: Column) -> Column:
        paths = F.filter(walks, lambda x: x["s"] < x["t"])
        # K3,3: the neighbours of a branch vertex are the other side, so no three meet in a triangle
        sides = F.size(F.array_distinct(F.transform(branches, lambda s: F.sort_array(F.array_distinct(F.transform(F.filter(walks, lambda x: (x["s"] == s) & (x["t"] != s)), lambda x: x["t"]))))))
        pairs = lambda p: F.size(F.array_distinct(F.transform(p, lambda x: F.struct(x["s"], x["t"]))))
        kind = lambda p: (
            F.when((degrees == "44444") & (pairs(p) == 10) & (F.size(p) == 10), "K5")
            .when((degrees == "333333") & (pairs(p) == 9) & (F.size(p) == 9) & (sides == 2), "K3,3")
            .when((degrees == "3333") & (pairs(p) == 6) & (F.size(p) == 6), "K4")
            .when((degrees == "33") & (pairs(p) == 1) & (F.size(p) == 3) & (F.array_min(F.transform(p, lambda x: x["length"])) > 1), "K2,3")
        )
        covered = lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + x["length"])
        return _with(paths, lambda p: F.struct(kind(p).alias("kind"), covered(p).alias("covered")))

    # of other degrees no path is walked: they are no homeomorph, and could have many branches
    few = lambda b, d: F.when(d.isin("44444", "333333", "3333", "33"), b).otherwise(F.array().cast("array<int>"))
    walks = lambda b, d: F.flatten(F.transform(few(b, d), lambda s: F.transform(F.get(near, s), lambda w: walk(s, w))))
    return _with(branches, lambda b: _with(degrees, lambda d: _with(walks(b, d), lambda w: judged(b, d, w))))


def _obstruction_reasons() -> Column:
    g6, marked = F.col("g6"), F.col("obstruction")
    codes = lambda es: F.transform(es, lambda e: _code(e["u"], e["v"]))
    # a vertex once less in its own list
    near = F.transform(_near(marked, order_of(g6)), lambda ws, v: F.concat(F.filter(ws, lambda w: w != v), F.array_repeat(v, F.size(F.filter(ws, lambda w: w == v)) - 1)))
    found = _with(near, lambda x: _kind(x, marked))
    allowed = F.create_map(*[x for c, names in SHAPES.items() for x in (F.lit(c), F.array(*map(F.lit, names)))])
    wrong = lambda k: k["kind"].isNull() | (k["covered"] != F.size(marked)) | ~F.array_contains(allowed[F.col("cmd")], k["kind"])
    return _with(found, lambda k: _reasons({"an edge is not in the graph": F.size(F.array_except(codes(marked), codes(edge_array(g6)))) > 0, "not an allowed homeomorph": wrong(k)}))


def obstruction_failures(decided: DataFrame) -> DataFrame:
    """Obstructions that are not subgraphs, or not a homeomorph that their command allows.
    Paths of inner vertices (degree 2) are followed from branch vertex to branch vertex; then
    the pairs of ends and the shape of degrees are compared."""
    return _offenders(decided.where("obstruction IS NOT NULL"), _obstruction_reasons())


def _crossings() -> Column:
    """(u, w, v): the edges (u, w) of a drawing that cross the vertex v."""
    crosses = lambda e, x: (x["v"] != e["u"]) & (x["v"] != e["v"]) & x["pos"].between(e["start"], e["end"]) & e["pos"].between(x["start"], x["end"])
    return F.flatten(F.transform("vis_e", lambda e: F.transform(F.filter("vis_v", lambda x: crosses(e, x)), lambda x: F.struct(e["u"].alias("u"), e["v"].alias("w"), x["v"].alias("v")))))


def drawing_conflicts(decided: DataFrame) -> DataFrame:
    """(g6, u, w, v): edges (u, w) of drawings that cross the vertex v, compared within each
    drawing's row."""
    return decided.where("vis_v IS NOT NULL").select("g6", F.explode(_crossings()).alias("x")).select("g6", "x.u", "x.w", "x.v")


def failures(decided: DataFrame) -> DataFrame:
    """All failures of a frame of verdicts with certificates, in one pass."""
    none = F.array().cast("array<string>")
    crossed = F.when((F.col("cmd") == "d") & (F.size(_crossings()) > 0), F.array(F.lit("an edge crosses a vertex"))).otherwise(none)
    parts = [F.when(F.col(c).isNotNull(), x).otherwise(none) for c, x in (("rotation", _embedding_reasons()), ("obstruction", _obstruction_reasons()), ("vis_v", crossed))]
    return _offenders(decided, F.concat(*parts))
