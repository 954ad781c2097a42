"""SQL that states the queries once more, for another engine to check them by."""

from __future__ import annotations

from textwrap import indent

K = 15

#: Both modalities of the stand-in features, as doubles.
FEATURES = """
feats AS (
  SELECT vec_id AS i, label, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS img, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS txt
  FROM embeddings
)"""


def near(side: str, k: int = K) -> str:
    return f"""
near_{side} AS (
  SELECT i, j, d, rank FROM (
    SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM (
      SELECT x.i, y.i AS j, list_distance(x.{side}, y.{side}) AS d FROM feats x, feats y WHERE x.i <> y.i))
  WHERE rank <= {k}
)"""


def cosine(side: str, k: int) -> str:
    """Neighbours by cosine, the row itself among them."""
    vector = side if side != "joint" else None
    unit = f"list_transform({vector}, lambda x: x / greatest(sqrt(list_sum(list_transform({vector}, lambda y: y * y))), 1e-8))" if vector else "v"
    source = "feats" if vector else "(SELECT i, list_transform(v0, lambda x: x / greatest(sqrt(list_sum(list_transform(v0, lambda y: y * y))), 1e-8)) AS v FROM (SELECT i, list_concat(" + ", ".join(f"list_transform({s}, lambda x: x / greatest(sqrt(list_sum(list_transform({s}, lambda y: y * y))), 1e-12))" for s in ("img", "txt")) + ") AS v0 FROM feats))"
    return f"""
unit_{side} AS (SELECT i, {unit} AS u FROM {source}),
cos_{side} AS (
  SELECT i, j, d, rank FROM (
    SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM (
      SELECT x.i, y.i AS j, 1 - list_dot_product(x.u, y.u) AS d FROM unit_{side} x, unit_{side} y))
  WHERE rank <= {k}
)"""


def graph(side: str, k: int = K) -> str:
    """Scales by doubling and halving, directed memberships, and the graph made symmetric twice."""
    value = "list_sum(list_transform(ds, lambda d: exp(-greatest(0.0, d - rho) / {w})))"
    return f"""
rows_{side} AS (SELECT i, list(d ORDER BY rank) AS ds, min(d) AS rho FROM near_{side} GROUP BY i),
up_{side} AS (
  SELECT i, ds, rho, 1.0::DOUBLE AS hi FROM rows_{side}
  UNION ALL SELECT i, ds, rho, hi * 2 FROM up_{side} WHERE hi <= 1e6 AND {value.format(w="hi")} < log2({k + 1})
),
cut_{side} AS (
  SELECT i, ds, rho, 1e-6::DOUBLE AS lo, max(hi) AS hi, 0 AS n FROM up_{side} GROUP BY i, ds, rho
  UNION ALL SELECT i, ds, rho, CASE WHEN v > log2({k + 1}) THEN lo ELSE mid END, CASE WHEN v > log2({k + 1}) THEN mid ELSE hi END, n + 1
  FROM (SELECT *, (lo + hi) * 0.5 AS mid, {value.format(w="((lo + hi) * 0.5)")} AS v FROM cut_{side} WHERE n < 64)
),
scale_{side} AS (SELECT i, rho, greatest((lo + hi) * 0.5, 1e-6) AS sigma FROM cut_{side} WHERE n = 64),
dir_{side} AS (SELECT n.i, n.j, least(exp(-greatest(0.0, n.d - s.rho) / s.sigma), 1.0) AS w FROM near_{side} n JOIN scale_{side} s USING (i)),
once_{side} AS (
  SELECT i, j, sum(a) + sum(b) - sum(a) * sum(b) AS w FROM (
    SELECT i, j, w AS a, 0.0::DOUBLE AS b FROM dir_{side} UNION ALL SELECT j, i, 0.0, w FROM dir_{side})
  GROUP BY i, j
),
{side}_g AS (SELECT i, j, 2 * w - w * w AS w FROM once_{side} WHERE w <> 0)"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE" + ",".join(c.rstrip() for c in ctes) + "\n" + select.strip()


IMG = (FEATURES, near("img"), graph("img"))
BOTH = (*IMG, near("txt"), graph("txt"))
NODES = """
nodes AS (SELECT i FROM feats)"""


def union_of(source: str) -> str:
    """A + A' - A A' of a relation of edges."""
    return f"""SELECT i, j, a + b - a * b AS w FROM (
  SELECT i, j, sum(a) AS a, sum(b) AS b FROM (
    SELECT i, j, w AS a, 0.0::DOUBLE AS b FROM {source} UNION ALL SELECT j, i, 0.0, w FROM {source})
  GROUP BY i, j) WHERE a + b - a * b <> 0"""


ALIGNED = """
ab AS (
  SELECT i, j, coalesce(a.w, 0) AS a, coalesce(b.w, 0) AS b FROM img_g a FULL JOIN txt_g b USING (i, j)
)"""


def top(name: str, source: str, k: int) -> str:
    return f"""
{name} AS (SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS r FROM {source}) WHERE r <= {k})"""


def collapse(side: str, k: int = K) -> str:
    """Local collapse of the nodes of a graph."""
    t = f"top_{side}"
    return f"""{top(t, f"{side}_g", k)},
size_{side} AS (SELECT i, count(*) AS n, sqrt(sum(w * w)) AS base, sum(w) AS s FROM {t} GROUP BY i),
cos_r_{side} AS (
  SELECT x.i, x.j AS m, sum(e.w * c.w) AS dot, sqrt(sum(e.w * e.w)) AS own
  FROM {t} x JOIN {side}_g e ON e.i = x.j JOIN {t} c ON c.i = x.i AND c.j = e.j GROUP BY x.i, x.j
),
red_{side} AS (
  SELECT s.i, CASE WHEN s.n > 1 THEN coalesce(sum(CASE WHEN r.own > 1e-8 AND s.base > 1e-8 THEN least(greatest(r.dot / greatest(s.base * r.own, 1e-8), 0), 1) ELSE 0 END), 0) / s.n ELSE 0 END AS red
  FROM size_{side} s LEFT JOIN cos_r_{side} r USING (i) GROUP BY s.i, s.n
),
p_{side} AS (SELECT x.i, greatest(x.w / greatest(s.s, 1e-8), 1e-8) AS p0, s.n FROM {t} x JOIN size_{side} s USING (i)),
sep_{side} AS (
  SELECT i, CASE WHEN n > 1 THEN least(greatest(-sum(p * ln(p + 1e-8)) / greatest(ln(n + 1e-8), 1e-8), 0), 1) ELSE 0 END AS sep
  FROM (SELECT i, n, p0 / sum(p0) OVER (PARTITION BY i) AS p FROM p_{side}) GROUP BY i, n
),
col_{side} AS (SELECT i, least(greatest(0.5 * red + 0.5 * sep, 0), 1) AS c FROM red_{side} JOIN sep_{side} USING (i))"""


WEIGHTS = """
q AS (
  SELECT b.*, exp(-4.0 * 0.5 * (xi.c + xj.c)) AS qi, exp(-4.0 * 0.5 * (yi.c + yj.c)) AS qt
  FROM ab b JOIN col_img xi ON xi.i = b.i JOIN col_img xj ON xj.i = b.j JOIN col_txt yi ON yi.i = b.i JOIN col_txt yj ON yj.i = b.j
),
weights AS (
  SELECT i, j, a, b, CASE WHEN qt >= qi THEN 0.3 * greatest(1 - qi / (qt + 1e-8), 0) ELSE 0 END AS t2i,
    CASE WHEN qi > qt THEN 0.3 * greatest(1 - qt / (qi + 1e-8), 0) ELSE 0 END AS i2t FROM q
)"""


def entropy(side: str, temperature: float = 0.07) -> str:
    return f"""
ent_{side} AS (
  SELECT i, -sum(p * ln(greatest(p, 1e-8))) AS e FROM (
    SELECT i, x / greatest(sum(x) OVER (PARTITION BY i), 1e-8) AS p FROM (
      SELECT i, exp((1 - d) / {temperature} - max((1 - d) / {temperature}) OVER (PARTITION BY i)) AS x FROM cos_{side}))
  GROUP BY i
),
div_{side} AS (SELECT i, avg(d) FILTER (rank > 1) AS v FROM cos_{side} GROUP BY i)"""


def best(score: str, source: str, k: int = 50) -> str:
    return f"SELECT i, row_number() OVER (ORDER BY s DESC, i) AS rank, round(s, 6) AS score FROM (SELECT i, {score} AS s FROM {source}) ORDER BY s DESC, i LIMIT {k}"


def mix(key: str, seed: int = 0) -> str:
    """The repeatable pseudo-random number of an integer key."""
    x = f"((({key}) * 1103515245 + {12345 + 7919 * seed}) % 2147483648)"
    x = f"(({x} * 69069 + 1) % 2147483648)"
    return f"(((({x}) // 65536) * 40503 + {x}) % 2147483648)"


def block(text: str) -> str:
    return indent(text.strip(), "  ")
