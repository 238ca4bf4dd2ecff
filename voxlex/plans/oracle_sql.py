"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code: fixtures as CTEs over the driver
views, windows and aggregates in plain SQL, and the ridge queries in closed
form for two features (2x2 normal equations), which is exact for any alpha.
Floats are rounded to 6 digits on both sides; scores are rounded to 9
digits before every argmax over alphas.
"""

from __future__ import annotations

import numpy as np

ALPHAS = [float(a) for a in np.logspace(0, 3, 20)]

# name -> (deps, body)
FIX = {
    "tok": ((), r"""
        SELECT CAST(doc_id AS BIGINT) AS seq, CAST(p - 1 AS INTEGER) AS pos, w AS word,
               CAST(p - 1 AS DOUBLE) * 0.375 AS onset,
               CAST(p - 1 AS DOUBLE) * 0.375 + 0.25 AS "offset",
               CAST(floor((3.0 + CAST(p - 1 AS DOUBLE) * 0.375) / 1.5) AS INTEGER) AS tr
        FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w,
                     generate_subscripts(regexp_split_to_array(text, '\s+'), 1) AS p
              FROM documents)"""),
    "tok_bad": (("tok",), """
        SELECT seq, pos,
               CASE WHEN pos % 19 = 7 THEN NULL WHEN pos % 29 = 3 THEN '<unk>' ELSE word END AS word,
               CASE WHEN pos % 23 = 5 THEN NULL ELSE onset END AS onset,
               "offset", tr
        FROM tok"""),
    "resp": ((), """
        SELECT CAST(l_linenumber AS INTEGER) AS subject,
               CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS tr,
               CAST(l_suppkey AS INTEGER) AS voxel, avg(l_quantity) AS value
        FROM lineitem GROUP BY 1, 2, 3"""),
    "resp_nan": (("resp",), """
        SELECT subject, tr, voxel,
               CASE WHEN voxel % 17 = 0 THEN CAST(0.0 AS DOUBLE)
                    WHEN (tr + voxel + subject) % 23 = 0 THEN CAST('NaN' AS DOUBLE)
                    ELSE value END AS value
        FROM resp"""),
    "resp_mean": (("resp",), "SELECT tr, voxel, avg(value) AS value FROM resp GROUP BY tr, voxel"),
    "resp_dense": (("resp", "resp_mean"), """
        SELECT f.tr, s.voxel, coalesce(m.value, 0.0) AS value
        FROM (SELECT DISTINCT tr FROM resp) f
        CROSS JOIN (SELECT DISTINCT voxel FROM resp) s
        LEFT JOIN resp_mean m ON m.tr = f.tr AND m.voxel = s.voxel"""),
    "stim": ((), """
        SELECT CAST(vec_id % 83 AS INTEGER) AS tr, vec_id,
               list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x
        FROM embeddings"""),
    "stim_k2": (("stim",), "SELECT tr, avg(x[1]) AS x0, avg(x[2]) AS x1 FROM stim GROUP BY tr"),
    "part_t": ((), "SELECT c_name AS participant_id, c_mktsegment AS task FROM customer"),
    "mask_t": ((), """
        SELECT CAST(s_suppkey AS INTEGER) AS voxel,
               CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS mask
        FROM supplier"""),
    "groups_t": (("resp",), """
        SELECT DISTINCT voxel, CAST(voxel % 5 AS INTEGER) AS grp FROM resp WHERE voxel % 11 <> 0"""),
    "scores_a": (("resp_dense", "stim_k2"), """
        SELECT d.voxel, covar_pop(d.value, k.x0) / nullif(stddev_pop(d.value) * stddev_pop(k.x0), 0) AS corr
        FROM resp_dense d JOIN stim_k2 k ON k.tr = d.tr GROUP BY d.voxel"""),
    "scores_b": (("resp_dense", "stim_k2"), """
        SELECT d.voxel, covar_pop(d.value, k.x1) / nullif(stddev_pop(d.value) * stddev_pop(k.x1), 0) AS corr
        FROM resp_dense d JOIN stim_k2 k ON k.tr = d.tr GROUP BY d.voxel"""),
    "scores_ab": (("scores_a", "scores_b"), """
        SELECT 'a' AS run, voxel, corr FROM scores_a UNION ALL SELECT 'b' AS run, voxel, corr FROM scores_b"""),
    "nsup": ((), "SELECT count(*) AS n FROM supplier"),
    "participants_sel": (("part_t",), """
        SELECT participant_id, string_split(participant_id, '#')[2] AS subject
        FROM part_t WHERE contains(task, 'U')
          AND string_split(participant_id, '#')[2] NOT IN ('000000004', '000000013')"""),
    "prepared": (("resp", "tok", "participants_sel"), """
        SELECT tr, voxel,
               (value - avg(value) OVER (PARTITION BY tr)) / nullif(stddev_pop(value) OVER (PARTITION BY tr), 0) AS value
        FROM (SELECT * FROM (
                SELECT tr, voxel, avg(CASE WHEN isnan(value) THEN NULL ELSE value END) AS value
                FROM resp
                WHERE subject IN (SELECT CAST(subject AS INTEGER) FROM participants_sel)
                  AND tr IN (SELECT DISTINCT tr FROM tok)
                GROUP BY tr, voxel) m
              WHERE voxel IN (SELECT voxel FROM (
                  SELECT voxel, avg(CASE WHEN isnan(value) THEN NULL ELSE value END) AS value
                  FROM resp
                  WHERE subject IN (SELECT CAST(subject AS INTEGER) FROM participants_sel)
                    AND tr IN (SELECT DISTINCT tr FROM tok)
                  GROUP BY tr, voxel) q
                  GROUP BY voxel HAVING max(CASE WHEN value <> 0 THEN 1 ELSE 0 END) = 1))"""),
}


def hash_expr(word: str, j) -> str:
    """SQL twin of ``voxlex.functions.hash_unit``."""
    return (f"(CAST(CAST(concat('0x', substr(md5(concat({word}, '#', CAST({j} AS VARCHAR))), 1, 8)) AS BIGINT)"
            f" % 2001 - 1000 AS DOUBLE) / 1000.0)")


def with_fixtures(names, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding the named fixtures (and their dependencies) plus extra CTEs."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in FIX[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({FIX[n][1]})" for n in order]
    parts += [f"{n} AS ({b})" for n, b in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _alphas_values(alphas) -> str:
    return ", ".join(f"({i}, CAST({float(a)!r} AS DOUBLE))" for i, a in enumerate(alphas))


def ridge_k2(tag: str, x_cte: str, y_cte: str, keys=("voxel",), *, alphas=ALPHAS, nboots=5,
             chunklen=5, seed=42, test_size=0.2, nchunks=None, mode="series", fixed_alpha=None,
             weights=True, groups_cte=None, normalpha=False) -> list[tuple[str, str]]:
    """CTEs of a two-feature bootstrap ridge; names are prefixed by ``tag``.

    ``x_cte``: (tr, x0, x1); ``y_cte``: (keys..., tr, value).  Produces
    ``{tag}_cv`` (boot, keys, alpha_idx, corr), ``{tag}_mean`` (keys,
    alpha_idx, mean_corr), ``{tag}_alpha`` (keys, alpha) and ``{tag}_final``
    (keys, alpha, corr), plus ``{tag}_w`` (keys, w0, w1).
    """
    k = list(keys)
    kc = ", ".join(k)
    # normalpha: the penalty is alpha * (largest singular value of the rows in use),
    # i.e. alpha^2 * (largest eigenvalue of their 2x2 Gram matrix)
    lmax = "((g.a + g.c) / 2 + sqrt(pow((g.a - g.c) / 2, 2) + g.b * g.b))"
    a2cv = f"(al.alpha * al.alpha * {lmax})" if normalpha else "(al.alpha * al.alpha)"
    a2f = f"(a.alpha * a.alpha * {lmax})" if normalpha else "(a.alpha * a.alpha)"
    ky = ", ".join(f"y.{c}" for c in k)
    t = tag
    nch = (f"{int(nchunks)}" if nchunks is not None
           else f"(SELECT CAST(floor(CAST(0.2 AS DOUBLE) * n / {float(chunklen)}) AS INTEGER) FROM {t}_ntr)")
    ctes = [
        (f"{t}_fr", f"SELECT DISTINCT tr FROM {x_cte} WHERE tr IN (SELECT tr FROM {y_cte})"),
        (f"{t}_sp", f"""SELECT tr, idx, idx >= n - CAST(ceil(CAST({test_size!r} AS DOUBLE) * n) AS INTEGER) AS is_test
                       FROM (SELECT tr, CAST(row_number() OVER (ORDER BY tr) - 1 AS INTEGER) AS idx,
                                    count(*) OVER () AS n FROM {t}_fr)"""),
        (f"{t}_trn", f"SELECT tr, idx AS train_idx FROM {t}_sp WHERE NOT is_test"),
        (f"{t}_tst", f"SELECT tr FROM {t}_sp WHERE is_test"),
        (f"{t}_ntr", f"SELECT count(*) AS n FROM {t}_trn"),
        (f"{t}_ch", f"""SELECT tr, train_idx,
                          CASE WHEN floor(train_idx / {chunklen}) < floor(n / {chunklen})
                               THEN CAST(floor(train_idx / {chunklen}) AS INTEGER) END AS chunk
                       FROM {t}_trn, {t}_ntr"""),
        (f"{t}_boots", f"SELECT CAST(unnest(range({max(nboots, 1)})) AS INTEGER) AS boot"),
        (f"{t}_hc", f"""SELECT boot, chunk FROM (
                          SELECT b.boot, c.chunk, row_number() OVER (
                              PARTITION BY b.boot ORDER BY md5(concat_ws('|', '{seed}', CAST(b.boot AS VARCHAR),
                                                                       CAST(c.chunk AS VARCHAR))), c.chunk) AS r
                          FROM {t}_boots b, (SELECT DISTINCT chunk FROM {t}_ch WHERE chunk IS NOT NULL) c)
                       WHERE r <= {nch}"""),
        (f"{t}_held", f"SELECT h.boot, c.tr FROM {t}_ch c JOIN {t}_hc h ON h.chunk = c.chunk"),
        (f"{t}_rrow", f"""SELECT b.boot, r.tr FROM {t}_boots b, {t}_trn r
                         WHERE NOT EXISTS (SELECT 1 FROM {t}_held h WHERE h.boot = b.boot AND h.tr = r.tr)"""),
        (f"{t}_keys", f"SELECT DISTINCT {kc} FROM {y_cte}"),
        (f"{t}_y", f"""SELECT {', '.join('q.' + c for c in k)}, f.tr,
                          coalesce(CASE WHEN isnan(y.value) THEN NULL ELSE y.value END, 0.0) AS value
                       FROM {t}_keys q CROSS JOIN {t}_fr f
                       LEFT JOIN {y_cte} y ON {' AND '.join(f'y.{c} = q.{c}' for c in k)} AND y.tr = f.tr"""),
        (f"{t}_x", f"SELECT tr, x0, x1 FROM {x_cte} WHERE tr IN (SELECT tr FROM {t}_fr)"),
        (f"{t}_al", f"SELECT * FROM (VALUES {_alphas_values(alphas)}) v(alpha_idx, alpha)"),
        # cross-validation: normal equations on each bootstrap's training rows
        (f"{t}_g", f"""SELECT r.boot, sum(x0 * x0) AS a, sum(x0 * x1) AS b, sum(x1 * x1) AS c
                      FROM {t}_rrow r JOIN {t}_x x ON x.tr = r.tr GROUP BY r.boot"""),
        (f"{t}_xy", f"""SELECT r.boot, {ky}, sum(x.x0 * y.value) AS d0, sum(x.x1 * y.value) AS d1
                       FROM {t}_rrow r JOIN {t}_x x ON x.tr = r.tr JOIN {t}_y y ON y.tr = r.tr
                       GROUP BY r.boot, {ky}"""),
        (f"{t}_wb", f"""SELECT xy.boot, {', '.join('xy.' + c for c in k)}, al.alpha_idx,
                          ((g.c + {a2cv}) * xy.d0 - g.b * xy.d1) /
                          ((g.a + {a2cv}) * (g.c + {a2cv}) - g.b * g.b) AS w0,
                          ((g.a + {a2cv}) * xy.d1 - g.b * xy.d0) /
                          ((g.a + {a2cv}) * (g.c + {a2cv}) - g.b * g.b) AS w1
                       FROM {t}_xy xy JOIN {t}_g g ON g.boot = xy.boot CROSS JOIN {t}_al al"""),
        (f"{t}_cv", f"""SELECT w.boot, {', '.join('w.' + c for c in k)}, w.alpha_idx,
                          coalesce(covar_pop(y.value, x.x0 * w.w0 + x.x1 * w.w1) /
                                   nullif(stddev_pop(y.value) * stddev_pop(x.x0 * w.w0 + x.x1 * w.w1), 0), 0.0) AS corr
                       FROM {t}_wb w JOIN {t}_held h ON h.boot = w.boot
                       JOIN {t}_x x ON x.tr = h.tr
                       JOIN {t}_y y ON {' AND '.join(f'y.{c} = w.{c}' for c in k)} AND y.tr = h.tr
                       GROUP BY w.boot, {', '.join('w.' + c for c in k)}, w.alpha_idx"""),
        (f"{t}_mean", f"SELECT {kc}, alpha_idx, avg(corr) AS mean_corr FROM {t}_cv GROUP BY {kc}, alpha_idx"),
    ]
    if mode == "fixed":
        ctes.append((f"{t}_alpha", f"SELECT {kc}, CAST({float(fixed_alpha)!r} AS DOUBLE) AS alpha FROM {t}_keys"))
    elif mode == "series":
        ctes.append((f"{t}_alpha", f"""SELECT m.{', m.'.join(k)}, al.alpha FROM (
                        SELECT {kc}, alpha_idx, row_number() OVER (PARTITION BY {kc}
                               ORDER BY round(mean_corr, 9) DESC, alpha_idx) AS r FROM {t}_mean) m
                        JOIN {t}_al al ON al.alpha_idx = m.alpha_idx WHERE m.r = 1"""))
    elif mode == "single":
        ctes.append((f"{t}_best", f"""SELECT alpha_idx FROM (SELECT alpha_idx, avg(mean_corr) AS s FROM {t}_mean
                        GROUP BY alpha_idx) ORDER BY round(s, 9) DESC, alpha_idx LIMIT 1"""))
        ctes.append((f"{t}_alpha", f"""SELECT q.{', q.'.join(k)}, al.alpha FROM {t}_keys q
                        CROSS JOIN {t}_best b JOIN {t}_al al ON al.alpha_idx = b.alpha_idx"""))
    elif mode == "group":
        ctes.append((f"{t}_gm", f"""SELECT {kc}, max(grp) AS grp FROM {groups_cte} GROUP BY {kc}"""))
        ctes.append((f"{t}_gbest", f"""SELECT grp, alpha_idx FROM (
                        SELECT grp, alpha_idx, row_number() OVER (PARTITION BY grp
                               ORDER BY round(s, 9) DESC, alpha_idx) AS r
                        FROM (SELECT g.grp, m.alpha_idx, avg(m.mean_corr) AS s
                              FROM {t}_mean m JOIN {t}_gm g USING ({kc}) GROUP BY g.grp, m.alpha_idx))
                        WHERE r = 1"""))
        ctes.append((f"{t}_alpha", f"""SELECT q.{', q.'.join(k)}, coalesce(al.alpha, 0.0) AS alpha FROM {t}_keys q
                        LEFT JOIN {t}_gm g USING ({kc}) LEFT JOIN {t}_gbest b ON b.grp = g.grp
                        LEFT JOIN {t}_al al ON al.alpha_idx = b.alpha_idx"""))
    # final fit on the whole training part, scored on the test part
    ctes += [
        (f"{t}_gf", f"""SELECT sum(x0 * x0) AS a, sum(x0 * x1) AS b, sum(x1 * x1) AS c
                       FROM {t}_trn r JOIN {t}_x x ON x.tr = r.tr"""),
        (f"{t}_xyf", f"""SELECT {ky}, sum(x.x0 * y.value) AS d0, sum(x.x1 * y.value) AS d1
                        FROM {t}_trn r JOIN {t}_x x ON x.tr = r.tr JOIN {t}_y y ON y.tr = r.tr GROUP BY {ky}"""),
        (f"{t}_w", f"""SELECT xy.{', xy.'.join(k)}, a.alpha,
                          ((g.c + {a2f}) * xy.d0 - g.b * xy.d1) /
                          ((g.a + {a2f}) * (g.c + {a2f}) - g.b * g.b) AS w0,
                          ((g.a + {a2f}) * xy.d1 - g.b * xy.d0) /
                          ((g.a + {a2f}) * (g.c + {a2f}) - g.b * g.b) AS w1
                       FROM {t}_xyf xy JOIN {t}_alpha a USING ({kc}) CROSS JOIN {t}_gf g"""),
        (f"{t}_final", f"""SELECT w.{', w.'.join(k)}, w.alpha,
                          {'coalesce(' if weights else ''}covar_pop(y.value, x.x0 * w.w0 + x.x1 * w.w1) /
                          nullif(stddev_pop(y.value) * stddev_pop(x.x0 * w.w0 + x.x1 * w.w1), 0){', 0.0)' if weights else ''} AS corr
                       FROM {t}_w w JOIN {t}_tst s ON TRUE
                       JOIN {t}_x x ON x.tr = s.tr
                       JOIN {t}_y y ON {' AND '.join(f'y.{c} = w.{c}' for c in k)} AND y.tr = s.tr
                       GROUP BY w.{', w.'.join(k)}, w.alpha"""),
    ]
    return ctes


# ---------------------------------------------------------------------------
# Per-query oracle SQL
# ---------------------------------------------------------------------------

def r6(x: str) -> str:
    """Round to 6 digits; ``+ 0.0`` folds a negative zero into zero."""
    return f"(round({x}, 6) + 0.0)"


WS_SPACE = r"'[ \t\n\x0b\f\r]+'"
# Fixed value: the wording of the summary prompt.
HEADER = "This is a summary of the text so far: "


def _ctx_expr(ws: int) -> str:
    if ws == 0:
        return "word"
    return (f"string_agg(word, ' ' ORDER BY pos) OVER (PARTITION BY seq ORDER BY pos "
            f"ROWS BETWEEN {ws} PRECEDING AND CURRENT ROW)")


def _hash_frames(tag: str, ws: int, dim: int = 2, pool: str = "mean") -> list[tuple[str, str]]:
    """Per-frame mean of window-pooled hash vectors (the fused baseline stimulus)."""
    hs = ", ".join(f"{hash_expr('word', j)} AS h{j}" for j in range(dim))
    if pool == "last" or ws == 0:
        ev = ", ".join(f"h{j} AS e{j}" for j in range(dim))
        body = f"SELECT seq, pos, tr, {ev} FROM (SELECT *, {hs} FROM tok)"
    else:
        ev = ", ".join(f"avg(h{j}) OVER w AS e{j}" for j in range(dim))
        body = (f"SELECT seq, pos, tr, {ev} FROM (SELECT *, {hs} FROM tok) "
                f"WINDOW w AS (PARTITION BY seq ORDER BY pos ROWS BETWEEN {ws} PRECEDING AND CURRENT ROW)")
    xs = ", ".join(f"avg(e{j}) AS x{j}" for j in range(dim))
    return [(f"{tag}_ev", body), (f"{tag}_x", f"SELECT tr, {xs} FROM {tag}_ev GROUP BY tr")]


def _text_frames(tag: str, text_cte: str, pool: str) -> list[tuple[str, str]]:
    """Per-frame mean of hash embeddings of arbitrary texts (tokens split on whitespace)."""
    if pool == "last":
        tokx = f"regexp_split_to_array(trim(text), '\\s+')[-1]"
        body = (f"SELECT t.seq, t.pos, k.tr, {hash_expr(tokx, 0)} AS e0, {hash_expr(tokx, 1)} AS e1 "
                f"FROM {text_cte} t JOIN tok k ON k.seq = t.seq AND k.pos = t.pos")
        return [(f"{tag}_ev", body),
                (f"{tag}_x", f"SELECT tr, avg(e0) AS x0, avg(e1) AS x1 FROM {tag}_ev GROUP BY tr")]
    toks = (f"SELECT seq, pos, unnest(regexp_split_to_array(trim(text), '\\s+')) AS w FROM {text_cte}")
    body = (f"SELECT u.seq, u.pos, avg({hash_expr('u.w', 0)}) AS e0, avg({hash_expr('u.w', 1)}) AS e1 "
            f"FROM ({toks}) u GROUP BY u.seq, u.pos")
    return [(f"{tag}_ev", body),
            (f"{tag}_x", f"""SELECT k.tr, avg(e.e0) AS x0, avg(e.e1) AS x1 FROM {tag}_ev e
                             JOIN tok k ON k.seq = e.seq AND k.pos = e.pos GROUP BY k.tr""")]


def _text_hash_frames(tag: str, text_cte: str, pool: str) -> list[tuple[str, str]]:
    """Per-frame mean of ``TextHashEmbedder`` vectors: token hashes, the last
    token's replaced by the hash of the whole text."""
    if pool == "last":
        ev = ", ".join(f"{hash_expr('t.text', j)} AS e{j}" for j in range(2))
        body = f"SELECT t.seq, t.pos, k.tr, {ev} FROM {text_cte} t JOIN tok k ON k.seq = t.seq AND k.pos = t.pos"
        return [(f"{tag}_ev", body), (f"{tag}_x", f"SELECT tr, avg(e0) AS x0, avg(e1) AS x1 FROM {tag}_ev GROUP BY tr")]
    split = "regexp_split_to_array(trim(text), '\\s+')"
    sums = ", ".join(f"sum({hash_expr('w', j)}) AS s{j}" for j in range(2))
    ev = ", ".join(f"(u.s{j} - {hash_expr('t.lw', j)} + {hash_expr('t.text', j)}) / u.n AS e{j}" for j in range(2))
    return [(f"{tag}_t", f"SELECT seq, pos, text, {split} AS ws, {split}[-1] AS lw FROM {text_cte}"),
            (f"{tag}_s", f"SELECT seq, pos, count(*) AS n, {sums} FROM (SELECT seq, pos, unnest(ws) AS w FROM {tag}_t) "
                         "GROUP BY seq, pos"),
            (f"{tag}_ev", f"SELECT k.tr, {ev} FROM {tag}_t t JOIN {tag}_s u ON u.seq = t.seq AND u.pos = t.pos "
                          "JOIN tok k ON k.seq = t.seq AND k.pos = t.pos"),
            (f"{tag}_x", f"SELECT tr, avg(e0) AS x0, avg(e1) AS x1 FROM {tag}_ev GROUP BY tr")]


def _window_hash_frames(tag: str, ws: int) -> list[tuple[str, str]]:
    """The same for trailing contexts, with token sums taken over windows."""
    w = f"OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN {ws} PRECEDING AND CURRENT ROW)"
    hs = ", ".join(f"{hash_expr('word', j)} AS h{j}" for j in range(2))
    sums = ", ".join(f"sum(h{j}) {w} AS s{j}" for j in range(2))
    ev = ", ".join(f"(s{j} - h{j} + {hash_expr('ctx', j)}) / n AS e{j}" for j in range(2))
    return [(f"{tag}_w", f"SELECT tr, h0, h1, count(*) {w} AS n, {sums}, {_ctx_expr(ws)} AS ctx "
                         f"FROM (SELECT *, {hs} FROM tok)"),
            (f"{tag}_x", f"SELECT tr, avg(e0) AS x0, avg(e1) AS x1 FROM (SELECT tr, {ev} FROM {tag}_w) GROUP BY tr")]


def _texts_at(tag: str, where: str, n: int, block: int) -> list[tuple[str, str]]:
    """The last ``n`` words up to every position that fulfils ``where``, by an
    equality join on position blocks."""
    return [
        (f"{tag}_a", f"SELECT seq, pos, unnest(range(greatest(0, (pos - {n - 1}) // {block}), pos // {block} + 1)) AS k "
                     f"FROM tok WHERE {where}"),
        (tag, f"""SELECT a.seq, a.pos, string_agg(t.word, ' ' ORDER BY t.pos) AS txt
                  FROM {tag}_a a JOIN (SELECT seq, pos, word, pos // {block} AS k FROM tok) t
                    ON t.seq = a.seq AND t.k = a.k AND t.pos BETWEEN a.pos - {n - 1} AND a.pos
                  GROUP BY a.seq, a.pos"""),
    ]


def _cont_text() -> list[tuple[str, str]]:
    return _texts_at("ct_p", "pos % 10 = 0", 30, 10) + [
        ("ct_c", f"SELECT seq, pos, {_ctx_expr(16)} AS ctx FROM tok"),
        ("ct_text", """SELECT c.seq, c.pos, concat(a.txt, '. This is the continuation of: ', c.ctx) AS text
                      FROM ct_c c JOIN ct_p a ON a.seq = c.seq AND a.pos = c.pos // 10 * 10"""),
    ]


def _summary_text(hold: bool = False) -> list[tuple[str, str]]:
    at = "CASE WHEN c.pos < 30 THEN 20 ELSE c.pos // 30 * 30 END" if hold else "c.pos"
    return _texts_at("sm_p", "pos >= 20 AND (pos % 30 = 0 OR pos = 20)", 500, 50) + [
        ("sm_c", f"SELECT seq, pos, {_ctx_expr(16)} AS ctx FROM tok"),
        ("sm_s", f"SELECT seq, pos, md5('{HEADER} The continuation is: ' || txt) AS summ FROM sm_p"),
        ("sm_text", f"""SELECT c.seq, c.pos,
                            CASE WHEN c.pos < 20 THEN c.ctx
                                 ELSE concat('{HEADER}', coalesce(s.summ, ''), ' : ', c.ctx) END AS text
                        FROM sm_c c LEFT JOIN sm_s s ON s.seq = c.seq AND s.pos = {at}"""),
    ]


def _describe(src: str, by: str, v: str = "corr") -> str:
    return (f"SELECT {by}, count({v}) AS count, {r6(f'avg({v})')} AS mean, {r6(f'stddev_samp({v})')} AS std, "
            f"{r6(f'min({v})')} AS min, {r6(f'quantile_cont({v}, 0.25)')} AS q25, "
            f"{r6(f'quantile_cont({v}, 0.5)')} AS q50, {r6(f'quantile_cont({v}, 0.75)')} AS q75, "
            f"{r6(f'max({v})')} AS max FROM {src} GROUP BY {by}")


def _cov_eig() -> list[tuple[str, str]]:
    """Sample covariance of STIM_K2 and its two eigenpairs (largest first)."""
    return [
        ("cv_s", """SELECT var_samp(x0) AS a, covar_samp(x0, x1) AS b, var_samp(x1) AS c FROM stim_k2"""),
        ("cv_e", """SELECT a, b, c, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1,
                           (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2 FROM cv_s"""),
    ]


def _ridge_final(tag: str, **kw) -> str:
    return f"SELECT voxel, {r6('alpha')} AS alpha, {r6('corr')} AS corr FROM {tag}_final"


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    W = with_fixtures

    q["src_responses"] = W(["resp", "nsup"], f"""
        SELECT subject, CASE WHEN voxel < h THEN 'L' ELSE 'R' END AS hemi, tr,
               CAST(CASE WHEN voxel < h THEN voxel ELSE voxel - h END AS INTEGER) AS voxel, {r6('value')} AS value
        FROM resp, (SELECT CAST(n // 2 AS INTEGER) AS h FROM nsup)""")
    q["src_surfaces"] = q["src_responses"]
    q["stage_roundtrip"] = W(["tok"], "SELECT seq, pos, word, tr FROM tok")
    q["drop_incomplete"] = W(["tok_bad"], f"""
        SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS INTEGER) AS pos, word,
               {r6('onset')} AS onset
        FROM tok_bad WHERE word IS NOT NULL AND onset IS NOT NULL""")
    q["participants_in_task"] = W(["part_t"], "SELECT participant_id, task FROM part_t WHERE contains(task, 'U')")
    q["exclude_participants"] = W(["participants_sel"], "SELECT participant_id, subject FROM participants_sel")
    q["subject_code"] = W(["part_t"], "SELECT participant_id, string_split(participant_id, '#')[2] AS subject FROM part_t")
    q["nth_participant"] = W(["participants_sel"], """
        SELECT participant_id, subject FROM (
            SELECT *, row_number() OVER (ORDER BY participant_id) AS r FROM participants_sel) WHERE r = 3""")
    q["replace_unk"] = W(["tok_bad"], """
        SELECT seq, pos, CASE WHEN word = '<unk>' THEN '<|endoftext|>' ELSE word END AS word FROM tok_bad""")
    q["frame_binning"] = W(["tok"], """
        SELECT seq, pos, CAST(floor((3.0 + onset) / 1.5) AS INTEGER) AS tr_onset,
               CAST(floor((3.0 + "offset") / 1.5) AS INTEGER) AS tr_offset FROM tok""")
    q["distinct_frames"] = W(["tok"], "SELECT seq, tr, min(pos) AS first_pos, count(*) AS n_words FROM tok GROUP BY seq, tr")
    q["nan_to_zero"] = W(["resp_nan"], f"""
        SELECT subject, tr, voxel, {r6('CASE WHEN value IS NULL OR isnan(value) THEN 0.0 ELSE value END')} AS value
        FROM resp_nan""")
    live = [("m", "SELECT tr, voxel, avg(CASE WHEN isnan(value) THEN NULL ELSE value END) AS value FROM resp_nan GROUP BY tr, voxel"),
            ("lv", "SELECT voxel FROM m GROUP BY voxel HAVING max(CASE WHEN value <> 0 THEN 1 ELSE 0 END) = 1")]
    q["live_series"] = W(["resp_nan"], f"SELECT tr, voxel, {r6('value')} AS value FROM m WHERE voxel IN (SELECT voxel FROM lv)", live)
    q["dense_index"] = W(["resp_nan"], """
        SELECT voxel, CAST(row_number() OVER (ORDER BY voxel) - 1 AS INTEGER) AS dense_idx FROM lv""", live)
    q["split_hemi"] = W(["resp_mean", "nsup"], """
        SELECT tr, voxel, CASE WHEN voxel < h THEN 'L' ELSE 'R' END AS hemi,
               CAST(CASE WHEN voxel < h THEN voxel ELSE voxel - h END AS INTEGER) AS vertex
        FROM resp_mean, (SELECT CAST(n // 2 AS INTEGER) AS h FROM nsup)""")
    q["unpack_series"] = W(["resp_dense"], f"SELECT tr, voxel, {r6('value')} AS value FROM resp_dense")
    q["pack_series"] = W(["resp_dense"], f"""
        SELECT voxel, CAST(count(*) AS INTEGER) AS n_frames, {r6('first(value ORDER BY tr)')} AS first_value,
               {r6('last(value ORDER BY tr)')} AS last_value, {r6('sum(value * rn)')} AS checksum
        FROM (SELECT *, row_number() OVER (PARTITION BY voxel ORDER BY tr) AS rn FROM resp_dense) GROUP BY voxel""")
    q["masked_diff"] = W(["scores_a", "scores_b"], f"""
        SELECT a.voxel, {r6('CASE WHEN abs(b.corr) > 0.2 THEN a.corr - b.corr ELSE 0.0 END')} AS diff
        FROM scores_a a JOIN scores_b b ON b.voxel = a.voxel""")
    q["threshold_map"] = W(["scores_a"], f"""
        SELECT voxel, {r6('greatest(CAST(-0.6 AS DOUBLE), least(CAST(0.6 AS DOUBLE), corr))')} AS corr
        FROM scores_a WHERE abs(corr) >= 0.1""")
    q["gather_frames"] = W(["resp", "tok"], f"""
        SELECT subject, tr, voxel, {r6('value')} AS value FROM resp WHERE tr IN (SELECT DISTINCT tr FROM tok)""")
    q["align_frames"] = W(["resp_dense", "stim_k2"], f"""
        SELECT d.tr, d.voxel, {r6('d.value')} AS value, {r6('k.x0')} AS x0, {r6('k.x1')} AS x1
        FROM resp_dense d JOIN stim_k2 k ON k.tr = d.tr""")
    q["score_diff"] = W(["scores_a", "scores_b"], f"""
        SELECT a.voxel, {r6('a.corr - b.corr')} AS diff FROM scores_a a JOIN scores_b b ON b.voxel = a.voxel""")
    q["scatter_grid"] = W(["scores_a", "nsup"], f"""
        SELECT CAST(g.i AS INTEGER) AS voxel, {r6('coalesce(a.corr, 0.0)')} AS corr
        FROM (SELECT unnest(range(2 * n)) AS i FROM nsup) g LEFT JOIN scores_a a ON a.voxel = g.i""")
    q["apply_mask"] = W(["scores_a", "mask_t"], f"""
        SELECT a.voxel, {r6('a.corr * coalesce(m.mask, 0.0)')} AS corr
        FROM scores_a a LEFT JOIN mask_t m ON m.voxel = a.voxel""")
    q["nanmean_subjects"] = W(["resp_nan"], f"""
        SELECT tr, voxel, {r6('avg(CASE WHEN isnan(value) THEN NULL ELSE value END)')} AS value
        FROM resp_nan GROUP BY tr, voxel""")
    q["frame_embedding"] = W(["stim"], f"""
        SELECT tr, CAST(j - 1 AS INTEGER) AS j, {r6('avg(v)')} AS value
        FROM (SELECT tr, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM stim) GROUP BY tr, j""")
    q["describe_scores"] = W(["scores_ab"], _describe("scores_ab", "run"))
    q["above_threshold"] = W(["scores_ab"], f"""
        SELECT run, n_above, n, {r6('round(CAST(100.0 AS DOUBLE) * n_above / n, 2)')} AS pct_above FROM (
            SELECT run, count(*) FILTER (WHERE corr > 0.3) AS n_above, count(corr) AS n
            FROM scores_ab GROUP BY run)""")
    subj = [
        ("sd", """SELECT q.subject, q.voxel, f.tr, coalesce(r.value, 0.0) AS value
                  FROM (SELECT DISTINCT subject, voxel FROM resp) q CROSS JOIN (SELECT DISTINCT tr FROM resp) f
                  LEFT JOIN resp r ON r.subject = q.subject AND r.voxel = q.voxel AND r.tr = f.tr"""),
        ("ss", """SELECT CAST(sd.subject AS VARCHAR) AS subject, sd.voxel,
                         covar_pop(sd.value, k.x0) / nullif(stddev_pop(sd.value) * stddev_pop(k.x0), 0) AS corr
                  FROM sd JOIN stim_k2 k ON k.tr = sd.tr GROUP BY sd.subject, sd.voxel"""),
    ]
    summ = f"""SELECT subject, {r6('max(corr)')} AS max_corr, count(*) FILTER (WHERE corr > 0.3) AS n_above
               FROM {{src}} GROUP BY subject"""
    q["subject_summary"] = W(["resp", "stim_k2"], summ.format(src="ss"), subj)
    q["subject_summary_no_avg"] = W(["resp", "stim_k2", "scores_a"], f"""
        SELECT * FROM ({summ.format(src="(SELECT subject, voxel, corr FROM ss UNION ALL SELECT 'Avg', voxel, corr FROM scores_a)")})
        WHERE subject <> 'Avg'""", subj)
    q["over_under"] = W(["scores_ab"], """
        SELECT run, count(*) FILTER (WHERE corr > 0.2) - count(*) FILTER (WHERE -corr > 0.2) AS over_under
        FROM scores_ab GROUP BY run""")
    rk = ridge_k2("rk", "stim_k2", "resp_dense")
    q["alpha_profile"] = W(["stim_k2", "resp_dense"], f"""
        SELECT boot, alpha_idx, {r6('avg(corr)')} AS mean_corr, {r6('max(corr)')} AS max_corr,
               count(*) FILTER (WHERE corr > 0.2) - count(*) FILTER (WHERE -corr > 0.2) AS over_under
        FROM rk_cv GROUP BY boot, alpha_idx""", rk)
    q["series_corr"] = W(["scores_a"], f"SELECT voxel, {r6('corr')} AS corr FROM scores_a")
    ap = [("ap", "SELECT d.voxel, d.value, k.x0 + k.x1 AS pred FROM resp_dense d JOIN stim_k2 k ON k.tr = d.tr")]
    q["signed_r2_blended"] = W(["resp_dense", "stim_k2"], f"""
        SELECT voxel, {r6('sqrt(abs(r2)) * sign(r2)')} AS corr FROM (
            SELECT voxel, 1 - var_pop(value - pred) / ((1 + var_pop(value)) / 2) AS r2 FROM ap GROUP BY voxel)""", ap)
    q["signed_r2_plain"] = W(["resp_dense", "stim_k2"], f"""
        SELECT voxel, {r6('sqrt(abs(r2)) * sign(r2)')} AS corr FROM (
            SELECT voxel, 1 - var_pop(value - pred) / nullif(var_pop(value), 0) AS r2 FROM ap GROUP BY voxel)""", ap)
    q["mean_boot_scores"] = W(["stim_k2", "resp_dense"], f"SELECT voxel, alpha_idx, {r6('mean_corr')} AS mean_corr FROM rk_mean", rk)
    q["mean_boot_group"] = W(["stim_k2", "resp_dense", "groups_t"], f"""
        SELECT g.grp, m.alpha_idx, {r6('avg(m.mean_corr)')} AS mean_corr
        FROM rk_mean m JOIN groups_t g ON g.voxel = m.voxel GROUP BY g.grp, m.alpha_idx""", rk)
    q["mean_boot_all"] = W(["stim_k2", "resp_dense"], f"""
        SELECT alpha_idx, {r6('avg(mean_corr)')} AS mean_corr FROM rk_mean GROUP BY alpha_idx""", rk)
    q["best_alpha_series"] = W(["stim_k2", "resp_dense"], """
        SELECT voxel, alpha_idx AS best_alpha_idx FROM (
            SELECT voxel, alpha_idx, row_number() OVER (PARTITION BY voxel ORDER BY round(mean_corr, 9) DESC, alpha_idx) AS r
            FROM rk_mean) WHERE r = 1""", rk)
    q["alpha_usage"] = W(["stim_k2", "resp_dense"], f"SELECT {r6('alpha')} AS alpha, count(*) AS n_series FROM rk_final GROUP BY alpha", rk)
    q["score_histogram"] = W(["scores_ab"], f"""
        SELECT run, bin, {r6('lo + bin * (hi - lo) / 20')} AS bin_lo, n,
               {r6('n / sum(n) OVER (PARTITION BY run)')} AS prob
        FROM (SELECT run, lo, hi, CAST(least(floor((corr - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n
              FROM scores_ab, (SELECT min(corr) AS lo, max(corr) AS hi FROM scores_ab) WHERE corr IS NOT NULL
              GROUP BY 1, 2, 3, 4)""")
    kd = [
        ("st", """SELECT run, count(corr) AS n, stddev_samp(corr) AS sd, min(corr) AS mn, max(corr) AS mx
                  FROM scores_ab GROUP BY run"""),
        ("st2", "SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS h FROM st"),
        ("st3", "SELECT *, mn - 3.0 * h AS lo, (mx - mn + 6.0 * h) / 49 AS step FROM st2"),
        ("gk", "SELECT run, CAST(unnest(range(50)) AS INTEGER) AS k FROM st3"),
    ]
    q["score_kde"] = W(["scores_ab"], f"""
        SELECT s.run, g.k, {r6('s.lo + g.k * s.step')} AS x,
               {r6('sum(exp(-0.5 * pow((s.lo + g.k * s.step - a.corr) / s.h, 2))) / (s.n * s.h * sqrt(2 * pi()))')} AS density
        FROM st3 s JOIN gk g ON g.run = s.run JOIN scores_ab a ON a.run = s.run
        WHERE a.corr IS NOT NULL AND s.h > 0
        GROUP BY s.run, g.k, s.lo, s.step, s.n, s.h""", kd)
    tv = [("tv", f"""SELECT seq, tr, pos, 0 AS j, {hash_expr('word', 0)} AS h FROM tok
                     UNION ALL SELECT seq, tr, pos, 1 AS j, {hash_expr('word', 1)} AS h FROM tok""")]
    q["pool_mean"] = W(["tok"], f"SELECT seq, tr, j, {r6('avg(h)')} AS value FROM tv GROUP BY seq, tr, j", tv)
    q["pool_last"] = W(["tok"], f"SELECT seq, tr, j, {r6('arg_max(h, pos)')} AS value FROM tv GROUP BY seq, tr, j", tv)
    q["gram_matrix"] = W(["stim"], f"""
        SELECT CAST(p.i - 1 AS INTEGER) AS i, CAST(q.j - 1 AS INTEGER) AS j, {r6('sum(p.a * q.b)')} AS value
        FROM (SELECT vec_id, unnest(x) AS a, generate_subscripts(x, 1) AS i FROM stim) p
        JOIN (SELECT vec_id, unnest(x) AS b, generate_subscripts(x, 1) AS j FROM stim) q ON q.vec_id = p.vec_id
        GROUP BY p.i, q.j""")
    q["xty"] = W(["stim_k2", "resp_dense"], f"""
        SELECT d.voxel, 0 AS j, {r6('sum(k.x0 * d.value)')} AS value FROM resp_dense d JOIN stim_k2 k ON k.tr = d.tr GROUP BY d.voxel
        UNION ALL
        SELECT d.voxel, 1 AS j, {r6('sum(k.x1 * d.value)')} AS value FROM resp_dense d JOIN stim_k2 k ON k.tr = d.tr GROUP BY d.voxel""")
    for ws in (0, 4, 16):
        q[f"context_ws_{ws}"] = W(["tok"], f"SELECT seq, pos, {_ctx_expr(ws)} AS context FROM tok")
    q["prompt_30"] = W(["tok"], f"SELECT seq, pos, {_ctx_expr(29)} AS prompt FROM tok")
    q["summary_input"] = W(["tok"], f"""
        SELECT seq, pos, text FROM (SELECT seq, pos, {_ctx_expr(499)} AS text FROM tok)
        WHERE pos >= 20 AND (pos % 30 = 0 OR pos = 20)""")
    q["refresh_hold"] = W(["tok"], """
        SELECT seq, pos, pos % 10 = 0 AS is_refresh, CAST(floor(pos / 10) * 10 AS INTEGER) AS anchor FROM tok""")
    q["refresh_reset"] = W(["tok"], """
        SELECT seq, pos, is_refresh, CASE WHEN is_refresh THEN pos END AS anchor
        FROM (SELECT seq, pos, (pos >= 20 AND (pos % 30 = 0 OR pos = 20)) AS is_refresh FROM tok)""")
    for name, by in (("zscore_frame", "tr"), ("zscore_series", "voxel")):
        q[name] = W(["resp_dense"], f"""
            SELECT tr, voxel, {r6(f'(value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0)')} AS value
            FROM resp_dense WINDOW w AS (PARTITION BY {by})""")
    split = [("spl", """SELECT tr, CAST(rn - 1 AS INTEGER) AS idx,
                               rn - 1 >= n - CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS INTEGER) AS is_test
                        FROM (SELECT tr, row_number() OVER (ORDER BY tr) AS rn, count(*) OVER () AS n
                              FROM (SELECT DISTINCT tr FROM resp))"""),
             ("chk", """SELECT tr, idx AS train_idx,
                               CASE WHEN floor(idx / 5) < floor(n / 5) THEN CAST(floor(idx / 5) AS INTEGER) END AS chunk
                        FROM spl, (SELECT count(*) AS n FROM spl WHERE NOT is_test) WHERE NOT is_test"""),
             ("hck", """SELECT boot, chunk FROM (
                            SELECT b.boot, c.chunk, row_number() OVER (PARTITION BY b.boot
                                ORDER BY md5(concat_ws('|', '42', CAST(b.boot AS VARCHAR), CAST(c.chunk AS VARCHAR))), c.chunk) AS r
                            FROM (SELECT CAST(unnest(range(5)) AS INTEGER) AS boot) b,
                                 (SELECT DISTINCT chunk FROM chk WHERE chunk IS NOT NULL) c)
                        WHERE r <= (SELECT CAST(floor(CAST(0.2 AS DOUBLE) * count(*) / 5.0) AS INTEGER) FROM chk)""")]
    q["ordered_split"] = W(["resp"], "SELECT tr, idx, is_test FROM spl", split)
    q["chunk_ids"] = W(["resp"], "SELECT tr, train_idx, chunk FROM chk", split)
    q["holdout_chunks"] = W(["resp"], "SELECT boot, chunk FROM hck", split)
    q["holdout_complement"] = W(["resp"], """
        SELECT b.boot, c.tr, c.train_idx FROM (SELECT CAST(unnest(range(5)) AS INTEGER) AS boot) b, chk c
        WHERE NOT EXISTS (SELECT 1 FROM hck h WHERE h.boot = b.boot AND h.chunk = c.chunk)""", split)
    q["explained_curve"] = W(["stim_k2"], f"""
        SELECT 1 AS dims, {r6('l1 / (l1 + l2)')} AS explained FROM cv_e
        UNION ALL SELECT 2 AS dims, {r6('(l1 + l2) / (l1 + l2)')} AS explained FROM cv_e""", _cov_eig())
    q["stack_hemis"] = W(["resp"], f"SELECT subject, tr, voxel, {r6('value')} AS value FROM resp")
    q["pivot_runs"] = W(["scores_a", "scores_b"], f"""
        SELECT a.voxel, {r6('a.corr')} AS a, {r6('b.corr')} AS b FROM scores_a a JOIN scores_b b ON b.voxel = a.voxel""")
    q["feature_spectrum"] = W(["stim_k2"], f"""
        SELECT 0 AS k, {r6('sqrt((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b))')} AS sigma FROM g
        UNION ALL
        SELECT 1 AS k, {r6('sqrt(greatest((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 0))')} AS sigma FROM g""",
        [("g", "SELECT sum(x0 * x0) AS a, sum(x0 * x1) AS b, sum(x1 * x1) AS c FROM stim_k2")])
    fixed = ridge_k2("rf", "stim_k2", "resp_dense", mode="fixed", fixed_alpha=10.0, weights=True)
    q["ridge_weights_k2"] = W(["stim_k2", "resp_dense"], f"""
        SELECT voxel, 0 AS j, {r6('w0')} AS w FROM rf_w UNION ALL SELECT voxel, 1 AS j, {r6('w1')} AS w FROM rf_w""", fixed)
    fixed_nw = ridge_k2("rf", "stim_k2", "resp_dense", mode="fixed", fixed_alpha=10.0, weights=False)
    q["ridge_pred_k2"] = W(["stim_k2", "resp_dense"], _ridge_final("rf"), fixed_nw)
    q["ridge_grid_k2"] = W(["stim_k2", "resp_dense"], f"""
        SELECT w.voxel, w.alpha_idx,
               {r6('coalesce(covar_pop(y.value, x.x0 * w.w0 + x.x1 * w.w1) / nullif(stddev_pop(y.value) * stddev_pop(x.x0 * w.w0 + x.x1 * w.w1), 0), 0.0)')} AS corr
        FROM (SELECT xy.voxel, al.alpha_idx,
                     ((g.c + al.alpha * al.alpha) * xy.d0 - g.b * xy.d1) /
                     ((g.a + al.alpha * al.alpha) * (g.c + al.alpha * al.alpha) - g.b * g.b) AS w0,
                     ((g.a + al.alpha * al.alpha) * xy.d1 - g.b * xy.d0) /
                     ((g.a + al.alpha * al.alpha) * (g.c + al.alpha * al.alpha) - g.b * g.b) AS w1
              FROM rk_xyf xy CROSS JOIN rk_gf g CROSS JOIN rk_al al) w
        JOIN rk_tst s ON TRUE JOIN rk_x x ON x.tr = s.tr JOIN rk_y y ON y.voxel = w.voxel AND y.tr = s.tr
        GROUP BY w.voxel, w.alpha_idx""", rk)
    q["alpha_per_series_k2"] = W(["stim_k2", "resp_dense"], _ridge_final("rk"), rk)
    q["bootstrap_ridge_k2"] = W(["stim_k2", "resp_dense"], _ridge_final("rk"), rk)
    q["alpha_per_group_k2"] = W(["stim_k2", "resp_dense", "groups_t"], _ridge_final("rg"),
                                ridge_k2("rg", "stim_k2", "resp_dense", mode="group", groups_cte="groups_t"))
    q["ridge_normalpha_k2"] = W(["stim_k2", "resp_dense"], _ridge_final("rn"),
                                ridge_k2("rn", "stim_k2", "resp_dense", normalpha=True))
    q["alpha_single_k2"] = W(["stim_k2", "resp_dense"], _ridge_final("rs"),
                             ridge_k2("rs", "stim_k2", "resp_dense", mode="single"))
    q["predict_linear"] = W(["stim_k2", "resp_dense"], f"""
        SELECT w.voxel, k.tr, {r6('k.x0 * w.w0 + k.x1 * w.w1')} AS pred FROM rf_w w CROSS JOIN stim_k2 k""", fixed)
    q["scale_rows"] = W(["stim", "stim_k2"], f"""
        SELECT k.tr, 0 AS j, {r6('k.x0 * c.d')} AS value FROM stim_k2 k JOIN cnt c ON c.tr = k.tr
        UNION ALL SELECT k.tr, 1 AS j, {r6('k.x1 * c.d')} AS value FROM stim_k2 k JOIN cnt c ON c.tr = k.tr""",
        [("cnt", "SELECT tr, CAST(count(*) AS DOUBLE) AS d FROM stim GROUP BY tr")])
    q["scale_cols"] = W(["stim_k2"], f"""
        SELECT k.tr, 0 AS j, {r6('k.x0 * (1.0 / s.s0)')} AS value FROM stim_k2 k, sd s
        UNION ALL SELECT k.tr, 1 AS j, {r6('k.x1 * (1.0 / s.s1)')} AS value FROM stim_k2 k, sd s""",
        [("sd", "SELECT stddev_pop(x0) AS s0, stddev_pop(x1) AS s1 FROM stim_k2")])
    q["pca_ratio_k2"] = W(["stim_k2"], f"""
        SELECT 0 AS component, {r6('l1 / (l1 + l2)')} AS ratio FROM cv_e
        UNION ALL SELECT 1 AS component, {r6('l2 / (l1 + l2)')} AS ratio FROM cv_e""", _cov_eig())
    q["pca_project_k2"] = W(["stim_k2"], f"""
        SELECT k.tr, 0 AS component, {r6('abs(k.x0 * v.u0 + k.x1 * v.u1)')} AS abs_value FROM stim_k2 k, vec v
        UNION ALL
        SELECT k.tr, 1 AS component, {r6('abs(k.x0 * v.v0 + k.x1 * v.v1)')} AS abs_value FROM stim_k2 k, vec v""",
        _cov_eig() + [("vec", """SELECT b / sqrt(b * b + pow(l1 - a, 2)) AS u0, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) AS u1,
                                        b / sqrt(b * b + pow(l2 - a, 2)) AS v0, (l2 - a) / sqrt(b * b + pow(l2 - a, 2)) AS v1
                                 FROM cv_e""")])
    emb = [("ctx4", f"SELECT seq, pos, {_ctx_expr(4)} AS text FROM tok"),
           ("etok", "SELECT seq, pos, unnest(regexp_split_to_array(trim(text), '\\s+')) AS w FROM ctx4")]
    q["embed_hash_mean"] = W(["tok"], f"""
        SELECT seq, pos, 0 AS j, {r6(f"avg({hash_expr('w', 0)})")} AS value FROM etok GROUP BY seq, pos
        UNION ALL SELECT seq, pos, 1 AS j, {r6(f"avg({hash_expr('w', 1)})")} AS value FROM etok GROUP BY seq, pos""", emb)
    q["embed_hash_last"] = W(["tok"], f"""
        SELECT seq, pos, 0 AS j, {r6(hash_expr('word', 0))} AS value FROM tok
        UNION ALL SELECT seq, pos, 1 AS j, {r6(hash_expr('word', 1))} AS value FROM tok""")
    na = ", ".join(f"'{t}'" for t in ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                                      "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null"))
    words = "'\"' || word || ', ' || CAST(pos % 7 AS VARCHAR) || '\"'"
    q["src_transcript"] = W(["tok_bad"], f"""
        SELECT seq, pos, {words} AS word_orig, CASE WHEN word IN ({na}) THEN NULL ELSE word END AS word,
               {r6('onset')} AS onset, {r6('"offset"')} AS "offset"
        FROM (SELECT seq, pos, coalesce(word, 'NA') AS word, onset, "offset" FROM tok_bad)""")
    q["src_participants"] = W(["part_t"], "SELECT participant_id, task FROM part_t")
    q["src_mask"] = W(["mask_t"], "SELECT voxel, mask FROM mask_t")
    q["load_task"] = W(["tok", "part_t"], f"""
        SELECT seq, pos, word, {r6('onset')} AS onset, CAST(floor((first + onset) / 1.5) AS INTEGER) AS tr
        FROM tok, (SELECT CAST(subject AS INTEGER) * 0.25 AS first FROM (
            SELECT string_split(participant_id, '#')[2] AS subject FROM part_t WHERE contains(task, 'U'))
          WHERE subject NOT IN ('000000004', '000000013') ORDER BY subject LIMIT 1 OFFSET 2)""")
    q["enrich_continuation"] = W(["tok"], "SELECT seq, pos, text FROM ct_text", _cont_text())
    q["enrich_summary"] = W(["tok"], "SELECT seq, pos, text FROM sm_text", _summary_text())
    q["enrich_summary_hold"] = W(["tok"], "SELECT seq, pos, text FROM sm_text", _summary_text(True))
    q["encode_text_k2"] = W(["prepared", "tok"], _ridge_final("ent"),
                            _window_hash_frames("tx", 16) + ridge_k2("ent", "tx_x", "prepared"))
    q["prepare_responses"] = W(["prepared"], f"SELECT tr, voxel, {r6('value')} AS value FROM prepared")
    q["encode_baseline_k2"] = W(["prepared", "tok"], _ridge_final("enc"),
                                _hash_frames("hx", 16) + ridge_k2("enc", "hx_x", "prepared"))
    cw = []
    sizes = (0, 4, 8, 16, 32, 64, 128)
    for ws in sizes:
        cw += _hash_frames(f"h{ws}", ws) + ridge_k2(f"w{ws}", f"h{ws}_x", "prepared", weights=False)
    q["compare_windows_k2"] = W(["prepared", "tok"], " UNION ALL ".join(
        f"SELECT {ws} AS ws, voxel, {r6('alpha')} AS alpha, {r6('corr')} AS corr FROM w{ws}_final" for ws in sizes), cw)
    ct = []
    for ws in sizes:
        ct += _window_hash_frames(f"t{ws}", ws) + ridge_k2(f"v{ws}", f"t{ws}_x", "prepared", weights=False)
    q["compare_windows_text_k2"] = W(["prepared", "tok"], " UNION ALL ".join(
        f"SELECT {ws} AS ws, voxel, {r6('alpha')} AS alpha, {r6('corr')} AS corr FROM v{ws}_final" for ws in sizes), ct)
    base = _hash_frames("hb", 16) + ridge_k2("bs", "hb_x", "prepared")
    cont = _cont_text() + _text_frames("tc", "ct_text", "mean") + ridge_k2("tcr", "tc_x", "prepared")
    q["continuation_vs_baseline"] = W(["prepared", "tok"], f"""
        SELECT t.voxel, {r6('t.corr')} AS corr, {r6('b.corr')} AS base_corr, {r6('t.corr - b.corr')} AS diff
        FROM tcr_final t JOIN bs_final b ON b.voxel = t.voxel""", base + cont)
    summ_t = _summary_text() + _text_hash_frames("ts", "sm_text", "last") + ridge_k2("tsr", "ts_x", "prepared")
    text_base = _window_hash_frames("tb", 16) + ridge_k2("bs", "tb_x", "prepared")
    q["summary_vs_baseline"] = W(["prepared", "tok"], f"""
        SELECT t.voxel, {r6('t.corr')} AS corr, {r6('b.corr')} AS base_corr,
               {r6('CASE WHEN abs(b.corr) > 0.2 THEN t.corr - b.corr ELSE 0.0 END')} AS diff
        FROM tsr_final t JOIN bs_final b ON b.voxel = t.voxel""", text_base + summ_t)
    inter = [
        ("sel", "SELECT * FROM resp WHERE subject IN (SELECT CAST(subject AS INTEGER) FROM participants_sel)"),
        ("r1", """SELECT subject, tr, voxel, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM sel
                  WHERE voxel IN (SELECT voxel FROM prepared) AND tr IN (SELECT tr FROM prepared)"""),
        ("zs", """SELECT CAST(subject AS VARCHAR) AS subject, tr, voxel,
                         (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS value
                  FROM r1 WINDOW w AS (PARTITION BY subject, tr)
                  UNION ALL SELECT 'Avg' AS subject, tr, voxel, value FROM prepared"""),
    ] + ridge_k2("ri", "stim_k2", "zs", keys=("subject", "voxel"), weights=False)
    q["intersubject_k2"] = W(["prepared", "stim_k2", "participants_sel", "resp"], f"""
        SELECT subject, voxel, {r6('alpha')} AS alpha, {r6('corr')} AS corr FROM ri_final""", inter)
    q["stat_map"] = W(["scores_a", "mask_t", "nsup"], f"""
        SELECT voxel, {r6('corr')} AS corr, CASE WHEN voxel < n THEN 'L' ELSE 'R' END AS hemi,
               CAST(CASE WHEN voxel < n THEN voxel ELSE voxel - n END AS INTEGER) AS vertex
        FROM (SELECT g.voxel, greatest(CAST(-0.6 AS DOUBLE), least(CAST(0.6 AS DOUBLE), g.corr * m.mask)) AS corr
              FROM (SELECT CAST(i AS INTEGER) AS voxel, coalesce(a.corr, 0.0) AS corr
                    FROM (SELECT unnest(range(2 * n)) AS i FROM nsup) r LEFT JOIN scores_a a ON a.voxel = r.i) g
              JOIN mask_t m ON m.voxel = g.voxel
              WHERE abs(g.corr * m.mask) >= 0.1), nsup""")  # a place without a mask is 0, below the threshold
    # full width: the narrow queries' text over scores of all 64 elements
    wide = """(SELECT tr, j, avg(v) AS v FROM (
        SELECT tr, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM stim) GROUP BY tr, j)"""
    run = "'f' || lpad(CAST(s.j - 1 AS VARCHAR), 2, '0')"
    corr = "covar_pop(d.value, s.v) / nullif(stddev_pop(d.value) * stddev_pop(s.v), 0)"
    scores = f"""
        SELECT {run} AS run, d.voxel, {corr} AS corr FROM resp_dense d JOIN {wide} s ON s.tr = d.tr GROUP BY s.j, d.voxel"""
    for name in ("describe_scores", "above_threshold", "over_under", "score_histogram", "score_kde"):
        q[f"{name}_64"] = q[name].replace(FIX["scores_ab"][1], scores)
    q["series_corr_64"] = W(["resp_dense", "stim"], f"SELECT run, voxel, {r6('corr')} AS corr FROM sw", [("sw", scores)])
    q["score_diff_64"] = W(["resp_dense", "stim"], f"""
        SELECT a.run, a.voxel, {r6('a.corr - b.corr')} AS diff FROM sw a JOIN sw b ON b.voxel = a.voxel
         AND CAST(substr(b.run, 2) AS INTEGER) = (CAST(substr(a.run, 2) AS INTEGER) + 1) % 64""", [("sw", scores)])
    q["subject_summary_64"] = W(["resp", "stim"], summ.format(src="sw"), subj[:1] + [("sw", f"""
        SELECT CAST(d.subject AS VARCHAR) AS subject, d.voxel, s.j, {corr} AS corr
        FROM sd d JOIN {wide} s ON s.tr = d.tr GROUP BY d.subject, d.voxel, s.j""")])
    q["subject_summary_no_avg_64"] = q["subject_summary_64"]
    q["xty_64"] = W(["stim", "resp_dense"], f"""
        SELECT d.voxel, CAST(s.j - 1 AS INTEGER) AS j, {r6('sum(s.v * d.value)')} AS value
        FROM resp_dense d JOIN {wide} s ON s.tr = d.tr GROUP BY d.voxel, s.j""")
    q["scale_rows_64"] = W(["stim"], f"""
        SELECT s.tr, CAST(s.j - 1 AS INTEGER) AS j, {r6('s.v * c.d')} AS value
        FROM {wide} s JOIN (SELECT tr, CAST(count(*) AS DOUBLE) AS d FROM stim GROUP BY tr) c ON c.tr = s.tr""")
    q["scale_cols_64"] = W(["stim"], f"""
        SELECT s.tr, CAST(s.j - 1 AS INTEGER) AS j, {r6('s.v * (1.0 / c.sd)')} AS value
        FROM {wide} s JOIN (SELECT j, stddev_pop(v) AS sd FROM {wide} GROUP BY j) c ON c.j = s.j""")
    q["align_frames_64"] = W(["resp_dense", "stim"], f"""
        SELECT d.tr, d.voxel, {r6('d.value')} AS value, {", ".join(f"{r6(f's.x[{j + 1}]')} AS x{j}" for j in range(64))}
        FROM resp_dense d JOIN (SELECT tr, list(v ORDER BY j) AS x FROM {wide} GROUP BY tr) s ON s.tr = d.tr""")
    q["factor_reconstruct_64"] = q["frame_embedding"]
    q["pca_rebuild_64"] = q["pca_rebuild_randomised_64"] = W(["stim"], f"""
        SELECT CAST(a.j - 1 AS INTEGER) AS i, CAST(b.j - 1 AS INTEGER) AS j, {r6('covar_samp(a.v, b.v)')} AS value
        FROM w a JOIN w b ON b.tr = a.tr GROUP BY a.j, b.j""", [("w", f"SELECT * FROM {wide}")])
    q["pca_norms_64"] = W(["stim"], f"SELECT tr, {r6('sum(v * v)')} AS norm2 FROM {wide} GROUP BY tr")
    sw = [("sw", scores)]
    after = "CAST(substr(b.run, 2) AS INTEGER) = (CAST(substr(a.run, 2) AS INTEGER) + 1) % 64"
    q["masked_diff_64"] = W(["resp_dense", "stim"], f"""
        SELECT a.run, a.voxel, {r6('CASE WHEN abs(b.corr) > 0.2 THEN a.corr - b.corr ELSE 0.0 END')} AS diff
        FROM sw a JOIN sw b ON b.voxel = a.voxel AND {after}""", sw)
    clipped = r6("greatest(CAST(-0.6 AS DOUBLE), least(CAST(0.6 AS DOUBLE), corr))")
    q["threshold_map_64"] = W(["resp_dense", "stim"], f"SELECT run, voxel, {clipped} AS corr FROM sw WHERE abs(corr) >= 0.1", sw)
    grid = """SELECT r.run, CAST(g.i AS INTEGER) AS voxel, coalesce(a.corr, 0.0) AS corr
              FROM (SELECT unnest(range(2 * n)) AS i FROM nsup) g CROSS JOIN (SELECT DISTINCT run FROM sw) r
              LEFT JOIN sw a ON a.voxel = g.i AND a.run = r.run"""
    q["scatter_grid_64"] = W(["resp_dense", "stim", "nsup"], f"SELECT run, voxel, {r6('corr')} AS corr FROM ({grid})", sw)
    q["apply_mask_64"] = W(["resp_dense", "stim", "mask_t"], f"""
        SELECT a.run, a.voxel, {r6('a.corr * coalesce(m.mask, 0.0)')} AS corr FROM sw a LEFT JOIN mask_t m ON m.voxel = a.voxel""", sw)
    q["stat_map_64"] = W(["resp_dense", "stim", "mask_t", "nsup"], f"""
        SELECT run, voxel, {clipped} AS corr, CASE WHEN voxel < n THEN 'L' ELSE 'R' END AS hemi,
               CAST(CASE WHEN voxel < n THEN voxel ELSE voxel - n END AS INTEGER) AS vertex
        FROM (SELECT g.run, g.voxel, g.corr * m.mask AS corr FROM ({grid}) g JOIN mask_t m ON m.voxel = g.voxel), nsup
        WHERE abs(corr) >= 0.1""", sw)
    columns = (r6(f"max(corr) FILTER (WHERE run = 'f{j:02d}')") + f" AS f{j:02d}" for j in range(64))
    q["pivot_runs_64"] = W(["resp_dense", "stim"], f"SELECT voxel, {', '.join(columns)} FROM sw GROUP BY voxel", sw)
    whole = [("ap", f"""SELECT d.voxel, d.value, s.pred FROM resp_dense d
                        JOIN (SELECT tr, sum(v) AS pred FROM {wide} GROUP BY tr) s ON s.tr = d.tr""")]
    for name, v in (("blended", "((1 + var_pop(value)) / 2)"), ("plain", "nullif(var_pop(value), 0)")):
        q[f"signed_r2_{name}_64"] = W(["resp_dense", "stim"], f"""
            SELECT voxel, {r6('sqrt(abs(r2)) * sign(r2)')} AS corr FROM (
                SELECT voxel, 1 - var_pop(value - pred) / {v} AS r2 FROM ap GROUP BY voxel)""", whole)
    least = "least(min(p * m / rk) OVER (PARTITION BY run ORDER BY hits ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0)"
    q["score_significance_64"] = W(["resp_dense", "stim"], f"""
        SELECT run, voxel, {r6('diff')} AS diff, hits, {r6('p')} AS p, {r6(least)} AS q
        FROM (SELECT *, (hits + 1) / 100.0 AS p, count(*) OVER (PARTITION BY run) AS m,
                     count(*) OVER (PARTITION BY run ORDER BY hits) AS rk FROM ht)""", [
        ("xw", f"SELECT * FROM {wide} WHERE tr IN (SELECT tr FROM resp_dense)"),
        ("xz", "SELECT tr, j, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS z FROM xw WINDOW w AS (PARTITION BY j)"),
        ("yz", """SELECT tr, voxel, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z,
                         count(*) OVER w AS n FROM resp_dense WHERE tr IN (SELECT tr FROM xw) WINDOW w AS (PARTITION BY voxel)"""),
        ("dc", """SELECT 'f' || lpad(CAST(a.j - 1 AS VARCHAR), 2, '0') AS run, y.voxel, CAST(floor(y.tr / 5.0) AS INTEGER) AS c,
                         sum(y.z * (a.z - b.z) / y.n) AS d
                  FROM yz y JOIN xz a ON a.tr = y.tr JOIN xz b ON b.tr = y.tr AND b.j = a.j % 64 + 1
                  WHERE y.z IS NOT NULL GROUP BY ALL"""),
        ("sg", """SELECT c, p, 1 - 2 * (CAST(concat('0x', substr(md5(concat_ws('|', '42', CAST(p AS VARCHAR),
                         CAST(c AS VARCHAR))), 1, 8)) AS BIGINT) % 2) AS s
                  FROM (SELECT DISTINCT c FROM dc), (SELECT unnest(range(99)) AS p)"""),
        ("ob", "SELECT run, voxel, sum(d) AS diff FROM dc GROUP BY run, voxel"),
        ("pm", "SELECT run, voxel, p, sum(d * s) AS t FROM dc JOIN sg USING (c) GROUP BY run, voxel, p"),
        ("ht", """SELECT o.run, o.voxel, any_value(o.diff) AS diff, count(*) FILTER (WHERE abs(m.t) >= abs(o.diff) - 1e-9) AS hits
                  FROM ob o JOIN pm m USING (run, voxel) GROUP BY o.run, o.voxel"""),
    ])
    q["alpha_grid"] = W(["stim_k2"], f"""
        SELECT alpha_idx, {r6('alpha')} AS alpha,
               {r6('alpha * sqrt((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b))')} AS scaled
        FROM (SELECT * FROM (VALUES {_alphas_values(ALPHAS)}) v(alpha_idx, alpha)),
             (SELECT sum(x0 * x0) AS a, sum(x0 * x1) AS b, sum(x1 * x1) AS c FROM stim_k2)""")
    q["bootstrap_tables_k2"] = W(["stim_k2", "resp_dense"], f"""
        SELECT 'fit' AS kind, voxel, CAST(NULL AS INTEGER) AS boot, CAST(NULL AS INTEGER) AS idx, {r6('alpha')} AS alpha, {r6('corr')} AS corr
        FROM rk_final
        UNION ALL SELECT 'boot', voxel, boot, alpha_idx, NULL, {r6('corr')} FROM rk_cv
        UNION ALL SELECT 'held', NULL, boot, tr, NULL, NULL FROM rk_held""", rk)
    q["enrich_summary_cumulative"] = W(["tok"], f"""
        SELECT c.seq, c.pos, CASE WHEN c.pos < 20 THEN c.ctx
               ELSE concat('{HEADER}', coalesce(s.summ, ''), ' : ', c.ctx) END AS text
        FROM (SELECT seq, pos, {_ctx_expr(16)} AS ctx FROM tok) c LEFT JOIN cs s
          ON s.seq = c.seq AND s.a = CASE WHEN c.pos < 30 THEN 20 ELSE c.pos // 30 * 30 END""", [
        ("pc", """SELECT seq, a, string_agg(word, ' ' ORDER BY pos) AS txt FROM (
                    SELECT seq, pos, word, CASE WHEN pos <= 20 THEN 20 ELSE (pos + 29) // 30 * 30 END AS a FROM tok)
                  GROUP BY seq, a HAVING max(pos) = a"""),
        ("pk", "SELECT *, row_number() OVER (PARTITION BY seq ORDER BY a) AS k FROM pc"),
        ("cs", f"""SELECT seq, a, k, md5('{HEADER} The continuation is: ' || txt) AS summ FROM pk WHERE k = 1
                   UNION ALL SELECT p.seq, p.a, p.k, md5('{HEADER}' || c.summ || ' The continuation is: ' || p.txt)
                   FROM cs c JOIN pk p ON p.seq = c.seq AND p.k = c.k + 1"""),
    ]).replace("WITH ", "WITH RECURSIVE ", 1)
    q["histogram_auto"] = W(["resp_dense", "stim"], f"""
        SELECT run, bin, {r6('lo + bin * (hi - lo) / m')} AS bin_lo, n, {r6('n / sum(n) OVER (PARTITION BY run)')} AS prob
        FROM (SELECT run, lo, hi, m, CAST(least(floor((corr - lo) / ((hi - lo) / m)), m - 1) AS INTEGER) AS bin, count(*) AS n
              FROM sw, (SELECT lo, hi, ceil((hi - lo) / CASE WHEN iqr > 0 THEN least(2 * iqr / pow(k, 1.0 / 3), st) ELSE st END) AS m
                        FROM (SELECT min(corr) AS lo, max(corr) AS hi, CAST(count(corr) AS DOUBLE) AS k,
                                     (max(corr) - min(corr)) / (log2(count(corr)) + 1) AS st,
                                     quantile_cont(corr, 0.75) - quantile_cont(corr, 0.25) AS iqr FROM sw))
              WHERE corr IS NOT NULL GROUP BY ALL)""", [("sw", scores)])
    q["ridge_wide_64"] = q["ridge_wide_additive_64"] = W(["stim", "resp_mean"], """
        SELECT m.voxel, CAST(s.j - 1 AS INTEGER) AS j, round(sum(s.v * m.value), 5) + 0.0 AS value
        FROM resp_mean m JOIN (SELECT tr, j, avg(v) AS v FROM (
            SELECT tr, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM stim) GROUP BY tr, j) s ON s.tr = m.tr
        GROUP BY m.voxel, s.j""")
    for name in ("ridge_weights_k2", "ridge_grid_k2", "alpha_per_series_k2", "alpha_per_group_k2", "alpha_single_k2",
                 "ridge_normalpha_k2"):
        q[name.replace("_k2", "_additive_k2")] = q[name]
    q["ridge_wide_dual_64"] = q["ridge_wide_64"]
    for name in ("alpha_per_series_k2", "ridge_normalpha_k2"):
        q[name.replace("_k2", "_dual_k2")] = q[name]
    q["ridge_more_features"] = W(["stim", "resp_mean"], f"""
        SELECT m.voxel, CAST(s.j AS INTEGER) AS j, round(sum(s.v * m.value), 4) + 0.0 AS value
        FROM resp_mean m JOIN (
            SELECT tr, j - 1 AS j, v FROM b UNION ALL SELECT tr, j + 63 AS j, v * v AS v FROM b
            UNION ALL SELECT p.tr, p.j + 127 AS j, p.v * n.v AS v FROM b p JOIN b n ON n.tr = p.tr AND n.j = p.j % 64 + 1) s
          ON s.tr = m.tr GROUP BY m.voxel, s.j""", [("b", f"SELECT * FROM {wide}")])
    pool = _hash_frames("pm", 16) + ridge_k2("pmr", "pm_x", "prepared") + \
        _hash_frames("pl", 16, pool="last") + ridge_k2("plr", "pl_x", "prepared")
    q["pooling_compare"] = W(["prepared", "tok"], _describe(
        "(SELECT 'mean' AS pool, corr FROM pmr_final UNION ALL SELECT 'last' AS pool, corr FROM plr_final)", "pool"), pool)
    return q
