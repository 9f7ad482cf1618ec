"""Heads with a hidden layer: one full-batch step from fixed parameters, checked in SQL.

The SQL spells out what a step is: dense layer, relu, batch normalization over the batch,
the head's top and loss, all gradients (through the batch moments), the first optimizer
move and the running moments, and then scores the test rows. Dropout is off here, as its
hash has no SQL form.
"""

import numpy as np
from pyspark.sql import functions as F

from twinlens.plans import heads as H
from twinlens.plans import train as TR
from twinlens.workload.base import query, r, rs
from twinlens.workload.models import SINGLE_SQL, experiment

UNITS, RATE = 4, 0.01

# one small integer per layer makes the start values differ
LAYERS = {
    "features": 1, "text_fc": 2, "image_fc": 5, "classifier": 3, "text_classifier": 4, "image_classifier": 6,
    "gate0": 7, "gate1": 8, "reweight0": 7, "reweight1": 8,
}


def layer_number(name: str) -> int:
    """The same layer of the next expert has a number larger by 3."""
    expert, _, base = name.rpartition(".")
    return LAYERS[base] + (3 * int(expert.removeprefix("expert")) if expert else 0)


def start(method):
    """Parameters from a rule that SQL can follow."""
    params, running = H.Spec(method, 32, 32, 10, UNITS).start(0)
    for name, value in params.items():
        layer, kind = name.rsplit(".", 1)
        o = np.arange(value.shape[0])
        if kind == "weight":
            params[name] = ((7 * o[:, None] + 3 * np.arange(value.shape[1]) + layer_number(layer)) % 13 - 6) / 24.0
        elif kind == "bias":
            params[name] = ((7 * o + layer_number(layer) + 4) % 13 - 6) / 24.0
    return params, running


def weight_sql(o: str, i: str, layer: str) -> str:
    return f"((7 * {o} + 3 * {i} + {layer}) % 13 - 6) / 24.0"


def bias_sql(o: str, layer: str) -> str:
    return f"((7 * {o} + {layer} + 4) % 13 - 6) / 24.0"


def dense_sql(name: str, layer: int, outputs: int, inputs: int) -> list[str]:
    """Start values of a top layer: <name>_w0(o, i, w) and <name>_b0(o, w)."""
    o, i = f"(SELECT unnest(range(0, {outputs})) AS o) oo", f"(SELECT unnest(range(0, {inputs})) AS i) ii"
    return [
        f"{name}_w0 AS MATERIALIZED (SELECT o, i, {weight_sql('o', 'i', str(layer))} AS w FROM {o}, {i})",
        f"{name}_b0 AS MATERIALIZED (SELECT o, {bias_sql('o', str(layer))} AS w FROM {o})",
    ]


def apply_sql(name: str, s: int, x: str) -> str:
    """(vec_id, o, z) of a layer on the table x(vec_id, i, v)."""
    return f"SELECT vec_id, o, q + bb.w AS z FROM (SELECT vec_id, o, sum(v * w) AS q FROM {x} JOIN {name}_w{s} USING (i) GROUP BY 1, 2) JOIN {name}_b{s} bb USING (o)"


def move_sql(name: str, keys: str, old: str, grad: str) -> str:
    """The first optimizer move of every value of a table."""
    return f"{name} AS MATERIALIZED (SELECT {keys}, w - {RATE} * g / (abs(g) + 1e-8) AS w FROM {old} JOIN ({grad}) USING ({keys}))"


def moves_sql(name: str, dz: str, x: str) -> list[str]:
    """Updated layer from dz(vec_id, o, d) and its input x(vec_id, i, v)."""
    return [
        move_sql(f"{name}_w1", "o, i", f"{name}_w0", f"SELECT o, i, sum(d * v) AS g FROM {dz} JOIN {x} USING (vec_id) GROUP BY 1, 2"),
        move_sql(f"{name}_b1", "o", f"{name}_b0", f"SELECT o, sum(d) AS g FROM {dz} GROUP BY 1"),
    ]


def softmax_sql(z: str) -> str:
    return f"SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM ({z})"


OFFSET = f"CASE WHEN b = 'image' THEN {UNITS} ELSE 0 END"


def hidden_sql(s: int, part: str) -> list[str]:
    """Branch outputs h{s}(b, vec_id, h, z, hat, v): batch moments at s = 0, running ones at s = 1."""
    mom = "mom" if s == 0 else "run"
    out = [
        f"""z{s} AS MATERIALIZED (SELECT b, vec_id, h, q + bb.w AS z FROM (SELECT b, vec_id, h, sum(x * w) AS q FROM xb JOIN first_w{s} USING (b, i) WHERE part = '{part}' GROUP BY 1, 2, 3) JOIN first_b{s} bb USING (b, h))"""
    ]
    if s == 0:
        out.append("mom AS MATERIALIZED (SELECT b, h, avg(greatest(z, 0)) AS mu, avg(greatest(z, 0) * greatest(z, 0)) - avg(greatest(z, 0)) * avg(greatest(z, 0)) AS var, count(*) AS n FROM z0 GROUP BY 1, 2)")
        out.append("run AS MATERIALIZED (SELECT b, h, 0.1 * mu AS mu, 0.9 + 0.1 * var * n / (n - 1) AS var FROM mom)")
    out.append(
        f"""h{s} AS MATERIALIZED (SELECT b, vec_id, h, z, hat, gam.w * hat + bet.w AS v, h + {OFFSET} AS i FROM (SELECT b, vec_id, h, z, (greatest(z, 0) - mu) / sqrt(var + 1e-5) AS hat FROM z{s} JOIN {mom} USING (b, h))
            JOIN gamma{s} gam USING (b, h) JOIN beta{s} bet USING (b, h))"""
    )
    return out


def top_sql(method: str, s: int) -> list[str]:
    """Class probabilities p{s}(vec_id, o, z, p) and what the top's gradient needs."""
    out = []
    if method == "gated_attention":
        out.append(f"u{s} AS MATERIALIZED (SELECT vec_id, o AS i, greatest(z, 0) AS v FROM ({apply_sql('gate0', s, f'h{s}')}))")
        out.append(f"gate{s} AS MATERIALIZED ({softmax_sql(apply_sql('gate1', s, f'u{s}'))})")
        out.append(
            f"mix{s} AS MATERIALIZED (SELECT h{s}.vec_id, h AS i, sum(p * v) AS v FROM h{s} JOIN gate{s} ON h{s}.vec_id = gate{s}.vec_id AND o = CASE WHEN b = 'image' THEN 1 ELSE 0 END GROUP BY 1, 2)"
        )
    x = f"mix{s}" if method == "gated_attention" else f"h{s}"
    out.append(f"p{s} AS MATERIALIZED ({softmax_sql(apply_sql('cls', s, x))})")
    if method == "mcr_late" and s == 0:
        for b in ("text", "image"):
            out.append(f"in_{b} AS (SELECT vec_id, h AS i, v FROM h0 WHERE b = '{b}')")
            out.append(f"aux_{b} AS MATERIALIZED ({softmax_sql(apply_sql(f'aux{b}', 0, f'in_{b}'))})")
    return out


def back_sql(method: str) -> list[str]:
    """dz of the classifier, the moves of the top layers and dh(b, vec_id, h, d)."""
    tgt = "(SELECT vec_id, c AS o, y, wt, lw FROM t WHERE part = 'train') tt"
    out = []
    if method == "mcr_late":
        nll = "(SELECT vec_id, -ln(p) AS l FROM {} JOIN " + tgt + " USING (vec_id, o) WHERE y = 1)"
        out.append(
            f"""worse AS MATERIALIZED (SELECT vec_id, CASE WHEN f.l > least(a.l, c.l) THEN 1.0 ELSE 0.0 END / count(*) OVER () AS worse, CASE WHEN a.l < c.l THEN 1.0 WHEN a.l = c.l THEN 0.5 ELSE 0.0 END AS best
            FROM {nll.format('p0')} f JOIN {nll.format('aux_text')} a USING (vec_id) JOIN {nll.format('aux_image')} c USING (vec_id))"""
        )
        out.append(f"dz AS MATERIALIZED (SELECT vec_id, o, (wt + worse) * (p - y) AS d FROM p0 JOIN {tgt} USING (vec_id, o) JOIN worse USING (vec_id))")
        for b, best in (("text", "best"), ("image", "(1 - best)")):
            out.append(f"dz_{b} AS MATERIALIZED (SELECT vec_id, o, ({H.AUX_WEIGHT} * wt - worse * {best}) * (p - y) AS d FROM aux_{b} JOIN {tgt} USING (vec_id, o) JOIN worse USING (vec_id))")
            out += moves_sql(f"aux{b}", f"dz_{b}", f"in_{b}")
    else:
        out.append(f"dz AS MATERIALIZED (SELECT vec_id, o, wt * (p - y) AS d FROM p0 JOIN {tgt} USING (vec_id, o))")
    out += moves_sql("cls", "dz", "mix0" if method == "gated_attention" else "h0")
    if method == "gated_attention":
        side = "CASE WHEN b = 'image' THEN 1 ELSE 0 END"
        out += [
            "dmix AS MATERIALIZED (SELECT vec_id, i AS h, sum(d * w) AS d FROM dz JOIN cls_w0 USING (o) GROUP BY 1, 2)",
            f"dg AS MATERIALIZED (SELECT h0.vec_id, {side} AS o, sum(d * v) AS dg FROM h0 JOIN dmix USING (vec_id, h) GROUP BY 1, 2)",
            "dgl AS MATERIALIZED (SELECT vec_id, o, p * (dg - sum(dg * p) OVER (PARTITION BY vec_id)) AS d FROM dg JOIN gate0 USING (vec_id, o))",
            *moves_sql("gate1", "dgl", "u0"),
            "du AS MATERIALIZED (SELECT vec_id, i AS o, CASE WHEN v > 0 THEN q ELSE 0 END AS d FROM (SELECT vec_id, i, sum(d * w) AS q FROM dgl JOIN gate1_w0 USING (o) GROUP BY 1, 2) JOIN u0 USING (vec_id, i))",
            *moves_sql("gate0", "du", "h0"),
            "dx AS MATERIALIZED (SELECT vec_id, i, sum(d * w) AS q FROM du JOIN gate0_w0 USING (o) GROUP BY 1, 2)",
            f"dh AS MATERIALIZED (SELECT b, h0.vec_id, h, q + p * dmix.d AS d FROM h0 JOIN dx USING (vec_id, i) JOIN dmix USING (vec_id, h) JOIN gate0 ON gate0.vec_id = h0.vec_id AND gate0.o = {side})",
        ]
        return out
    out.append("dx AS MATERIALIZED (SELECT vec_id, i, sum(d * w) AS q FROM dz JOIN cls_w0 USING (o) GROUP BY 1, 2)")
    if method == "mcr_late":
        both = " UNION ALL ".join(f"SELECT '{b}' AS b, vec_id, i AS h, sum(d * w) AS e FROM dz_{b} JOIN aux{b}_w0 USING (o) GROUP BY 1, 2, 3" for b in ("text", "image"))
        out.append(f"dh AS MATERIALIZED (SELECT h0.b, h0.vec_id, h0.h, q + e AS d FROM h0 JOIN dx USING (vec_id, i) JOIN ({both}) a ON a.b = h0.b AND a.vec_id = h0.vec_id AND a.h = h0.h)")
    else:
        out.append("dh AS MATERIALIZED (SELECT b, vec_id, h, q AS d FROM h0 JOIN dx USING (vec_id, i))")
    return out


def step_sql(method: str) -> str:
    early = method == "mlp_early"
    layer = "CASE b WHEN 'features' THEN 1 WHEN 'text' THEN 2 ELSE 5 END"
    if early:
        xb = "SELECT 'features' AS b, vec_id, part, CASE WHEN pos > 32 THEN pos - 33 ELSE pos + 31 END AS i, x FROM lo WHERE pos > 0"
    else:
        xb = "SELECT CASE WHEN pos > 32 THEN 'text' ELSE 'image' END AS b, vec_id, part, CASE WHEN pos > 32 THEN pos - 33 ELSE pos - 1 END AS i, x FROM lo WHERE pos > 0"
    units = f"(SELECT unnest(range(0, {UNITS})) AS h) hh"
    ctes = [
        f"xb AS MATERIALIZED ({xb})",
        f"first_w0 AS MATERIALIZED (SELECT b, h, i, {weight_sql('h', 'i', layer)} AS w FROM (SELECT DISTINCT b, i FROM xb), {units})",
        f"first_b0 AS MATERIALIZED (SELECT b, h, {bias_sql('h', layer)} AS w FROM (SELECT DISTINCT b FROM xb), {units})",
        "gamma0 AS (SELECT b, h, 1.0 AS w FROM first_b0)",
        "beta0 AS (SELECT b, h, 0.0 AS w FROM first_b0)",
    ]
    width = UNITS if early or method == "gated_attention" else 2 * UNITS
    ctes += dense_sql("cls", LAYERS["classifier"], 10, width)
    if method == "gated_attention":
        ctes += dense_sql("gate0", LAYERS["gate0"], UNITS, 2 * UNITS) + dense_sql("gate1", LAYERS["gate1"], 2, UNITS)
    if method == "mcr_late":
        ctes += dense_sql("auxtext", LAYERS["text_classifier"], 10, UNITS) + dense_sql("auximage", LAYERS["image_classifier"], 10, UNITS)
    ctes += hidden_sql(0, "train") + top_sql(method, 0) + back_sql(method)
    ctes += [
        "dbg AS MATERIALIZED (SELECT b, h, sum(d) AS db, sum(d * hat) AS dg FROM dh JOIN h0 USING (b, vec_id, h) GROUP BY 1, 2)",
        """d1 AS MATERIALIZED (SELECT b, vec_id, h, CASE WHEN z > 0 THEN (d - db / n - hat * dg / n) / sqrt(var + 1e-5) ELSE 0 END AS d
            FROM dh JOIN h0 USING (b, vec_id, h) JOIN dbg USING (b, h) JOIN mom USING (b, h))""",
        move_sql("gamma1", "b, h", "gamma0", "SELECT b, h, dg AS g FROM dbg"),
        move_sql("beta1", "b, h", "beta0", "SELECT b, h, db AS g FROM dbg"),
        move_sql("first_w1", "b, h, i", "first_w0", "SELECT b, h, i, sum(d * x) AS g FROM d1 JOIN xb USING (b, vec_id) GROUP BY 1, 2, 3"),
        move_sql("first_b1", "b, h", "first_b0", "SELECT b, h, sum(d) AS g FROM d1 GROUP BY 1, 2"),
    ]
    ctes += hidden_sql(1, "test") + top_sql(method, 1)
    gates = ""
    if method == "gated_attention":
        gates = f", {rs('(SELECT p FROM gate1 g WHERE g.vec_id = p1.vec_id AND g.o = 0)')} AS gate_text, {rs('(SELECT p FROM gate1 g WHERE g.vec_id = p1.vec_id AND g.o = 1)')} AS gate_image"
    return f"""WITH {SINGLE_SQL}, {', '.join(ctes)}
        SELECT p1.vec_id AS sample_id, label AS y_true, CAST(first(o ORDER BY p DESC, o) AS INTEGER) AS y_pred, {rs('max(p)')} AS top{gates} FROM p1 JOIN va ON va.vec_id = p1.vec_id GROUP BY 1, 2"""


def mixture_sql() -> str:
    """The expert mixture: 4 experts on the full input and with either modality zeroed."""
    eps, scale = H.DISTANCE_EPS, f"({H.AUX_WEIGHT} / (SELECT count(DISTINCT vec_id) FROM zz0))"
    side = "CASE b WHEN 'text' THEN 2 ELSE 5 END + 3 * e"
    experts, units = "(SELECT unnest(range(0, 4)) AS e) ee", f"(SELECT unnest(range(0, {UNITS})) AS h) hh"

    def hidden(s: int, part: str) -> list[str]:
        cases = "('full')" if s else "('full'), ('no_text'), ('no_image')"
        mom = "run" if s else "mom"
        out = [
            f"q{s} AS MATERIALIZED (SELECT e, b, vec_id, h, sum(x * w) AS q FROM xb JOIN first_w{s} USING (b, i) WHERE part = '{part}' GROUP BY 1, 2, 3, 4)",
            f"""z{s} AS MATERIALIZED (SELECT e, k, q.b, vec_id, q.h, CASE WHEN k = 'no_' || q.b THEN 0 ELSE q END + bb.w AS z FROM q{s} q JOIN first_b{s} bb USING (e, b, h), (VALUES {cases}) kk(k))""",
        ]
        if s == 0:
            out.append("mom AS MATERIALIZED (SELECT e, k, b, h, avg(greatest(z, 0)) AS mu, avg(greatest(z, 0) * greatest(z, 0)) - avg(greatest(z, 0)) * avg(greatest(z, 0)) AS var, count(*) AS n FROM z0 GROUP BY 1, 2, 3, 4)")
            turn = "CASE k WHEN 'full' THEN 0.081 WHEN 'no_text' THEN 0.09 ELSE 0.1 END"
            out.append(f"run AS MATERIALIZED (SELECT e, 'full' AS k, b, h, sum({turn} * mu) AS mu, 0.729 + sum({turn} * var * n / (n - 1)) AS var FROM mom GROUP BY 1, 3, 4)")
        out.append(
            f"""h{s} AS MATERIALIZED (SELECT e, k, b, vec_id, h, z, hat, gam.w * hat + bet.w AS v, h + {OFFSET} AS i FROM (SELECT e, k, b, vec_id, h, z, (greatest(z, 0) - mu) / sqrt(var + 1e-5) AS hat FROM z{s} JOIN {mom} USING (e, k, b, h))
                JOIN gamma{s} gam USING (e, b, h) JOIN beta{s} bet USING (e, b, h))"""
        )
        out.append(f"y{s} AS MATERIALIZED (SELECT e, k, vec_id, o, q + bb.w AS z FROM (SELECT e, k, vec_id, o, sum(v * w) AS q FROM h{s} JOIN cls_w{s} USING (e, i) GROUP BY 1, 2, 3, 4) JOIN cls_b{s} bb USING (e, o))")
        out.append(f"both{s} AS (SELECT vec_id, i + CASE WHEN b = 'image' THEN 32 ELSE 0 END AS i, x AS v FROM xb WHERE part = '{part}')")
        out.append(f"u{s} AS MATERIALIZED (SELECT vec_id, o AS i, greatest(z, 0) AS v FROM ({apply_sql('rew0', s, f'both{s}')}))")
        out.append(f"g{s} AS MATERIALIZED (SELECT vec_id, o AS e, p AS w FROM ({softmax_sql(apply_sql('rew1', s, f'u{s}'))}))")
        out.append(f"zz{s} AS MATERIALIZED ({softmax_sql(f'SELECT vec_id, o, sum(w * z) AS z FROM y{s} JOIN g{s} USING (vec_id, e) WHERE k = {chr(39)}full{chr(39)} GROUP BY 1, 2')})")
        return out

    near = "CASE WHEN e = 0 THEN 'no_image' ELSE 'no_text' END"
    far = "CASE WHEN e = 0 THEN 'no_text' ELSE 'no_image' END"
    ctes = [
        "xb AS MATERIALIZED (SELECT CASE WHEN pos > 32 THEN 'text' ELSE 'image' END AS b, vec_id, part, CASE WHEN pos > 32 THEN pos - 33 ELSE pos - 1 END AS i, x FROM lo WHERE pos > 0)",
        f"first_w0 AS MATERIALIZED (SELECT e, b, h, i, {weight_sql('h', 'i', '(' + side + ')')} AS w FROM (SELECT DISTINCT b, i FROM xb), {units}, {experts})",
        f"first_b0 AS MATERIALIZED (SELECT e, b, h, {bias_sql('h', '(' + side + ')')} AS w FROM (SELECT DISTINCT b FROM xb), {units}, {experts})",
        "gamma0 AS (SELECT e, b, h, 1.0 AS w FROM first_b0)",
        "beta0 AS (SELECT e, b, h, 0.0 AS w FROM first_b0)",
        f"cls_w0 AS MATERIALIZED (SELECT e, o, i, {weight_sql('o', 'i', '(3 + 3 * e)')} AS w FROM (SELECT unnest(range(0, 10)) AS o) oo, (SELECT unnest(range(0, {2 * UNITS})) AS i) ii, {experts})",
        f"cls_b0 AS MATERIALIZED (SELECT e, o, {bias_sql('o', '(3 + 3 * e)')} AS w FROM (SELECT unnest(range(0, 10)) AS o) oo, {experts})",
        *dense_sql("rew0", LAYERS["reweight0"], UNITS, 64),
        *dense_sql("rew1", LAYERS["reweight1"], 4, UNITS),
        *hidden(0, "train"),
        "dz AS MATERIALIZED (SELECT vec_id, o, wt * (p - y) AS d FROM zz0 JOIN (SELECT vec_id, c AS o, y, wt FROM t WHERE part = 'train') tt USING (vec_id, o))",
        "dg AS MATERIALIZED (SELECT vec_id, e, sum(d * z) AS dg FROM y0 JOIN dz USING (vec_id, o) WHERE k = 'full' GROUP BY 1, 2)",
        "dgl AS MATERIALIZED (SELECT vec_id, e AS o, w * (dg - sum(dg * w) OVER (PARTITION BY vec_id)) AS d FROM dg JOIN g0 USING (vec_id, e))",
        *moves_sql("rew1", "dgl", "u0"),
        "du AS MATERIALIZED (SELECT vec_id, i AS o, CASE WHEN v > 0 THEN q ELSE 0 END AS d FROM (SELECT vec_id, i, sum(d * w) AS q FROM dgl JOIN rew1_w0 USING (o) GROUP BY 1, 2) JOIN u0 USING (vec_id, i))",
        *moves_sql("rew0", "du", "both0"),
        # uniqueness experts: distances of the full output to the near and the far ablation
        f"""tri AS MATERIALIZED (SELECT f.e, f.vec_id, f.o, f.z - a.z + {eps} AS a, f.z - c.z + {eps} AS c FROM (SELECT * FROM y0 WHERE k = 'full' AND e < 2) f
            JOIN y0 a ON a.e = f.e AND a.vec_id = f.vec_id AND a.o = f.o AND a.k = CASE WHEN f.e = 0 THEN 'no_image' ELSE 'no_text' END
            JOIN y0 c ON c.e = f.e AND c.vec_id = f.vec_id AND c.o = f.o AND c.k = CASE WHEN f.e = 0 THEN 'no_text' ELSE 'no_image' END)""",
        "trn AS MATERIALIZED (SELECT e, vec_id, sqrt(sum(a * a)) AS na, sqrt(sum(c * c)) AS nc FROM tri GROUP BY 1, 2)",
        f"trg AS MATERIALIZED (SELECT e, vec_id, o, {scale} * a / na AS ga, {scale} * c / nc AS gc FROM tri JOIN trn USING (e, vec_id) WHERE na - nc + {H.MARGIN} > 0)",
        # synergy and redundancy experts: cosines with both ablations
        "cs AS MATERIALIZED (SELECT f.e, a.k, f.vec_id, f.o, f.z AS x, a.z AS v FROM (SELECT * FROM y0 WHERE k = 'full' AND e >= 2) f JOIN y0 a ON a.e = f.e AND a.vec_id = f.vec_id AND a.o = f.o AND a.k <> 'full')",
        f"cn AS MATERIALIZED (SELECT e, k, vec_id, greatest(sqrt(sum(x * x)), {H.COSINE_EPS}) AS nx, greatest(sqrt(sum(v * v)), {H.COSINE_EPS}) AS nv, sum(x * v) AS dot FROM cs GROUP BY 1, 2, 3)",
        f"""cg AS MATERIALIZED (SELECT e, k, vec_id, o, s * (v / (nx * nv) - dot / (nx * nv) * x / (nx * nx)) AS gx, s * (x / (nx * nv) - dot / (nx * nv) * v / (nv * nv)) AS gv
            FROM (SELECT *, {scale} * CASE WHEN e = 2 THEN 0.5 ELSE -0.5 END AS s FROM cs JOIN cn USING (e, k, vec_id)))""",
        f"""dy AS MATERIALIZED (SELECT e, k, vec_id, o, sum(d) AS d FROM (
            SELECT e, 'full' AS k, vec_id, o, w * d AS d FROM g0 JOIN dz USING (vec_id)
            UNION ALL SELECT e, k, vec_id, o, 0 FROM y0
            UNION ALL SELECT e, 'full', vec_id, o, ga - gc FROM trg UNION ALL SELECT e, {near}, vec_id, o, -ga FROM trg UNION ALL SELECT e, {far}, vec_id, o, gc FROM trg
            UNION ALL SELECT e, 'full', vec_id, o, gx FROM cg UNION ALL SELECT e, k, vec_id, o, gv FROM cg) GROUP BY 1, 2, 3, 4)""",
        move_sql("cls_w1", "e, o, i", "cls_w0", "SELECT e, o, i, sum(d * v) AS g FROM dy JOIN h0 USING (e, k, vec_id) GROUP BY 1, 2, 3"),
        move_sql("cls_b1", "e, o", "cls_b0", "SELECT e, o, sum(d) AS g FROM dy GROUP BY 1, 2"),
        "dx AS MATERIALIZED (SELECT e, k, vec_id, i, sum(d * w) AS d FROM dy JOIN cls_w0 USING (e, o) GROUP BY 1, 2, 3, 4)",
        "dh AS MATERIALIZED (SELECT e, k, b, vec_id, h, z, hat, d FROM h0 JOIN dx USING (e, k, vec_id, i))",
        "dbg AS MATERIALIZED (SELECT e, k, b, h, sum(d) AS db, sum(d * hat) AS dg FROM dh GROUP BY 1, 2, 3, 4)",
        "d1 AS MATERIALIZED (SELECT e, k, b, vec_id, h, CASE WHEN z > 0 THEN (d - db / n - hat * dg / n) / sqrt(var + 1e-5) ELSE 0 END AS d FROM dh JOIN dbg USING (e, k, b, h) JOIN mom USING (e, k, b, h))",
        move_sql("gamma1", "e, b, h", "gamma0", "SELECT e, b, h, sum(dg) AS g FROM dbg GROUP BY 1, 2, 3"),
        move_sql("beta1", "e, b, h", "beta0", "SELECT e, b, h, sum(db) AS g FROM dbg GROUP BY 1, 2, 3"),
        move_sql("first_w1", "e, b, h, i", "first_w0", "SELECT e, b, h, i, sum(d * x) AS g FROM (SELECT e, b, vec_id, h, sum(d) AS d FROM d1 WHERE k <> 'no_' || b GROUP BY 1, 2, 3, 4) JOIN xb USING (b, vec_id) GROUP BY 1, 2, 3, 4"),
        move_sql("first_b1", "e, b, h", "first_b0", "SELECT e, b, h, sum(d) AS g FROM d1 GROUP BY 1, 2, 3"),
        *hidden(1, "test"),
    ]
    return f"""WITH {SINGLE_SQL}, {', '.join(ctes)}
        SELECT zz1.vec_id AS sample_id, label AS y_true, CAST(first(o ORDER BY p DESC, o) AS INTEGER) AS y_pred, {rs('max(p)')} AS top FROM zz1 JOIN va ON va.vec_id = zz1.vec_id GROUP BY 1, 2"""


def one_step(spark, sf, method):
    options = TR.Options(method, epochs=1, lr=RATE, hidden=UNITS, dropout=0.0, batch_size=1 << 30)
    _, predictions = experiment(spark, sf).run(options, start=start(method))
    gates = [r(F.get("gates", F.lit(i))).alias(n) for i, n in enumerate(("gate_text", "gate_image"))] if "gates" in predictions.columns else []
    return predictions.select("sample_id", "y_true", "y_pred", r(F.array_max("probs")).alias("top"), *gates)


@query("fus_mlp_early", step_sql("mlp_early"))
def fus_mlp_early(spark, sf):
    return one_step(spark, sf, "mlp_early")


@query("fus_mlp_late", step_sql("mlp_late"))
def fus_mlp_late(spark, sf):
    return one_step(spark, sf, "mlp_late")


@query("fus_gated", step_sql("gated_attention"))
def fus_gated(spark, sf):
    return one_step(spark, sf, "gated_attention")


@query("fus_mcr", step_sql("mcr_late"))
def fus_mcr(spark, sf):
    return one_step(spark, sf, "mcr_late")


@query("fus_moe", mixture_sql())
def fus_moe(spark, sf):
    return one_step(spark, sf, "i2moe")
