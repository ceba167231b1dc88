"""Derived views over the star-schema tables, in SQL that Spark and DuckDB both run.

``{name}`` stands for a table or for another view. They give every operator an input of the shape
it expects (flashes, samples, registry, phrase bank, ...) that grows with the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_HIT = "stim_code = CAST(floor(target_cell / 3.0) AS INT) + 1 OR stim_code = 4 + target_cell % 3"

VIEWS: dict[str, str] = {
    "flashes": f"""
        SELECT run, CAST(run % 17 AS INT) AS subject, ord, char_idx, seq_idx, stim_code, target_cell,
               CASE WHEN {_HIT} THEN 1 ELSE 0 END AS y,
               ln(value + 1) - 3.5 + CASE WHEN {_HIT} THEN 1.2 ELSE 0.0 END AS logit
        FROM (SELECT run, ord, value, CAST(floor(ord / 12.0) AS INT) AS char_idx,
                     CAST(floor(ord / 6.0) AS INT) % 2 + 1 AS seq_idx, ord % 6 + 1 AS stim_code,
                     CAST((run * 5 + CAST(floor(ord / 12.0) AS INT) * 7) % 9 AS INT) AS target_cell
              FROM (SELECT user_id AS run, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) - 1 AS ord
                    FROM {{events}}) o) c""",
    "samples": """
        SELECT l_suppkey AS run,
               CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INT) - 1 AS sample,
               CAST(l_quantity AS DOUBLE) AS signal, CAST(l_extendedprice AS DOUBLE) AS price,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS stim_type,
               CAST(l_partkey % 6 AS INT) + 1 AS stim_code,
               CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 1 ELSE 0 END AS pulse
        FROM {lineitem}""",
    "channels": """
        SELECT DISTINCT run, channel FROM (
            SELECT l_suppkey AS run, concat('EEG_', CAST(l_linenumber AS VARCHAR(10))) AS channel FROM {lineitem}
            UNION ALL
            SELECT l_suppkey, CASE l_orderkey % (3 + l_suppkey % 3) WHEN 0 THEN 'StimulusBegin' WHEN 1 THEN 'StimulusType' WHEN 2 THEN 'StimulusCode' WHEN 3 THEN 'CurrentTarget' ELSE 'SelectedTarget' END FROM {lineitem}
            UNION ALL
            SELECT l_suppkey, concat(chr(CAST(65 + l_partkey % (1 + l_suppkey % 9) AS INT)), '_', CAST(1 + CAST(floor((l_partkey % (1 + l_suppkey % 9)) / 3.0) AS INT) AS VARCHAR(10)), '_', CAST(1 + (l_partkey % (1 + l_suppkey % 9)) % 3 AS VARCHAR(10)))
            FROM {lineitem} WHERE l_suppkey % 11 <> 0) c""",
    "registry": """
        SELECT concat('S', lpad(CAST(c_nationkey AS VARCHAR(10)), 2, '0'), '_SE001_',
                      CASE WHEN c_custkey % 3 = 0 THEN 'RC_Train' WHEN c_custkey % 3 = 1 THEN 'Dyn_Test' ELSE 'DynBigram_Test' END,
                      CAST(c_custkey AS VARCHAR(20))) AS session_id,
               c_mktsegment AS target_text, c_custkey FROM {customer}""",
    "heldout": "SELECT session_id FROM {registry} WHERE c_custkey % 5 = 0",
    "phrase_bank": """
        SELECT p_partkey AS bank_pos, p_name AS text, p_type AS source, CAST(p_size AS DOUBLE) AS weight, p_brand AS subject FROM {part}""",
    "contexts": "SELECT DISTINCT substr(p_name, 1, CAST(1 + p_partkey % 8 AS INT)) AS context FROM {part}",
    "grid": """
        SELECT CAST(r.v AS INT) AS row, CAST(c.v AS INT) AS col, CAST((r.v - 1) * 3 + c.v AS INT) AS code,
               CAST((r.v - 1) * 3 + c.v - 1 AS INT) AS cell_idx, substr('ABCDEFGHI', CAST((r.v - 1) * 3 + c.v AS INT), 1) AS label
        FROM (VALUES (1), (2), (3)) r(v) CROSS JOIN (VALUES (1), (2), (3)) c(v)""",
    "letters": "SELECT CAST(i - 1 AS INT) AS cell_idx, substr('abcdefghijklmnopqrstuvwxyz ', CAST(i AS INT), 1) AS ch FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18), (19), (20), (21), (22), (23), (24), (25), (26), (27)) v(i)",
    "masked": """
        SELECT run, char_idx, seq_idx, ord, stim_code, logit,
               CASE stim_code WHEN 1 THEN '111000000' WHEN 2 THEN '000111000' WHEN 3 THEN '000000111'
                              WHEN 4 THEN '100100100' WHEN 5 THEN '010010010' ELSE '001001001' END AS lit_mask
        FROM {flashes}""",
    "trials": "SELECT DISTINCT run, subject, char_idx, target_cell FROM {flashes}",
    "prior": """
        SELECT run, char_idx, cell_idx, CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY run, char_idx) AS p
        FROM (SELECT t.run, t.char_idx, g.cell_idx,
                     CASE WHEN g.cell_idx = (t.run + t.char_idx) % 9 THEN 0
                          ELSE 1 + (t.run + t.char_idx + g.cell_idx * g.cell_idx) % 7 END AS w
              FROM {trials} t CROSS JOIN {grid} g) x""",
    "scores": """
        SELECT event_id AS flash_id, user_id % 17 AS subject, CAST(CASE WHEN value > 30 THEN 1 ELSE 0 END AS INT) AS y,
               ln(value + 1) - 3.0 + (event_id % 7) / 4.0 AS logit FROM {events}""",
    "methods": "SELECT user_id AS subject, event_type AS method, avg(value) AS metric FROM {events} GROUP BY user_id, event_type",
    "epochs": "SELECT vec_id, embedding AS x, CASE WHEN label % 5 = 0 THEN 1 ELSE 0 END AS y, CAST(vec_id % 20 AS INT) AS run FROM {embeddings}",
    "paths": """
        SELECT c_custkey, concat('root/Study', chr(CAST(65 + c_nationkey % 4 AS INT)), '/D_', lpad(CAST(c_nationkey AS VARCHAR(10)), 2, '0'), '/SE00', CAST(1 + c_custkey % 3 AS VARCHAR(10)),
               CASE WHEN c_custkey % 2 = 0 THEN '/Train' ELSE '/Test' END,
               CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/Dyn' WHEN 2 THEN '/RC' ELSE '/DynBigram' END,
               '/run', CAST(c_custkey AS VARCHAR(20)), '.edf') AS path FROM {customer}""",
    "decisions": """
        SELECT run, char_idx, subject, CAST(run % 3 AS INT) AS condition, n_seq, conf, CASE WHEN (run * 3 + char_idx) % 4 <> 0 THEN target_cell ELSE (target_cell + 1) % 9 END AS decision, target_cell
        FROM (SELECT run, char_idx, max(subject) AS subject, max(target_cell) AS target_cell, CAST(count(DISTINCT seq_idx) AS INT) AS n_seq, 1 / (1 + exp(-max(logit))) AS conf FROM {flashes} GROUP BY run, char_idx) d""",
}


def _parts(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table of the directory."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{p: view(spark, sf_dir, p) for p in _parts(sql)})


def with_views(body: str) -> str:
    """DuckDB SQL for ``body``, whose ``{name}`` placeholders become common table expressions."""
    done: dict[str, str] = {}

    def need(sql: str) -> None:
        for p in _parts(sql):
            if p in VIEWS and p not in done:
                need(VIEWS[p])
                done[p] = VIEWS[p]

    need(body)
    plain = lambda sql: re.sub(r"\{(\w+)\}", r"\1", sql)
    ctes = ", ".join(f"{k} AS ({plain(v)})" for k, v in done.items())
    body = plain(body)
    if not ctes:
        return body
    return f"WITH {ctes}, {body.strip()[5:]}" if body.strip()[:5].upper() == "WITH " else f"WITH {ctes} {body}"
