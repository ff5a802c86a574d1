"""Queries over the engine's own operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog as C
from . import sqltext as S
from .functions import protocol as P
from .functions import scoring
from .functions.features import features_of, rendered, with_features
from .functions.text import plain_smiles, term
from .operators import episodes as E
from .operators import fanout as R
from .operators import metrics as A
from .operators import molecules as M
from .operators import names as J
from .operators import traces as T
from .plans import evaluate, scripted
from .runtime import cut, read, scratch
from .sources.readers import read_dictionary, read_rows, scan, write_rows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
SEED = 5


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_SPLIT_TEXT = """sized AS (SELECT g, count(*) AS size, {h} AS k FROM {rows} GROUP BY g),
 placed AS (SELECT g, coalesce(sum(size) OVER (ORDER BY k, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM sized),
 named AS (SELECT g, CASE WHEN before < 0.8::DOUBLE * total THEN 'train' WHEN before < (0.8::DOUBLE + 0.1::DOUBLE) * total THEN 'val' ELSE 'test' END AS split FROM placed)"""

# --- scripted agents over closed-form molecules ------------------------------------------------------------------------

_CHAIN = """mol AS (SELECT p_partkey AS key, 1 + p_partkey % 9 AS n, p_size % 3 AS t,
  repeat('C', (1 + p_partkey % 9)::INT) || ['', 'O', 'N'][1 + p_size % 3] AS smiles FROM part)"""
_LABEL = """CASE prop WHEN 'mw' THEN (round({n} * 12.011 + (2 * {n} + 2) * 1.008 + CASE t WHEN 1 THEN 15.999 WHEN 2 THEN 15.015 ELSE 0 END, 4))::DOUBLE::VARCHAR
 WHEN 'hbd' THEN CASE WHEN t = 0 THEN '0' ELSE '1' END WHEN 'ring_count' THEN '0' WHEN 'validity' THEN 'True'
 WHEN 'formula' THEN 'C' || CASE WHEN {n} > 1 THEN {n}::VARCHAR ELSE '' END || 'H' || (2 * {n} + 2 + CASE t WHEN 2 THEN 1 ELSE 0 END)::VARCHAR || ['', 'O', 'N'][1 + t] END"""
# The wrong molecule has one more carbon behind its tail: an ether or a secondary amine.
_TOLD = """CASE WHEN act = 4 THEN CASE prop WHEN 'hbd' THEN CASE WHEN t = 2 THEN '1' ELSE '0' END ELSE """ + _LABEL.format(n="(n + 1)") + """ END
 WHEN act = 6 THEN '12345' ELSE """ + _LABEL.format(n="n") + " END"
_ONE_CALL = f"""WITH {_CHAIN}, ep AS (SELECT *, {S.draw(scripted.SEED, "'agent'", 'key', 'prop')} % 8 AS act
  FROM mol, {S.values([(p,) for p in scripted.PROPS_V1], 'prop')}),
said AS (SELECT key, prop, act, {_LABEL.format(n='n')} AS truth, {_TOLD} AS told FROM ep),
res AS (SELECT key, prop, CASE WHEN act <> 5 THEN told END AS final,
  act <> 5 AND act <> 6 AND (told = truth OR (prop = 'mw' AND abs(try_cast(told AS DOUBLE) - try_cast(truth AS DOUBLE)) <= 0.1)) AS correct,
  act NOT IN (4, 5) AS tool_valid FROM said)"""


@query(_ONE_CALL + " SELECT key, prop, final, correct, tool_valid, correct AND tool_valid AS strict_correct FROM res")
def episode_one_call(spark, d):
    episodes, turns = scripted.one_call_episodes(read(spark, d, "part"))
    return E.score_one_call(episodes, turns).select("key", "prop", "final", "correct", "tool_valid", "strict_correct")


_METRICS = """ SELECT coalesce({k}, '_all') AS key, count(*) AS n, sum(correct::INT)::BIGINT AS correct, sum(tool_valid::INT)::BIGINT AS tool_valid,
 round(sum(correct::INT)::BIGINT / count(*), 3) AS accuracy, round(sum(tool_valid::INT)::BIGINT / count(*), 3) AS valid_rate
 FROM res GROUP BY ROLLUP ({k})"""


@query(_ONE_CALL + _METRICS.format(k="prop"))
def flagship(spark, d):
    episodes, turns = scripted.one_call_episodes(read(spark, d, "part"))
    return A.report_order(A.metrics(E.score_one_call(episodes, turns), "prop"))


@query(_ONE_CALL + " SELECT key, prop, final, tool_valid FROM res WHERE NOT correct ORDER BY key, prop LIMIT 10")
def failures_first_ten(spark, d):
    episodes, turns = scripted.one_call_episodes(read(spark, d, "part"))
    wrong = E.score_one_call(episodes, turns).where(~F.col("correct"))
    return wrong.select("key", "prop", "final", "tool_valid").orderBy("key", "prop").limit(10)


@query(_ONE_CALL + " SELECT key, prop, final, correct, tool_valid FROM res")
def episode_general(spark, d):
    episodes, turns = scripted.one_call_episodes(read(spark, d, "part"))
    scored = E.score_general(episodes, turns)
    # A turn of prose is an answer here; without the marker it holds no final.
    return scored.select("key", "prop", "final", "correct", "tool_valid")


_KINDS = f"""WITH {_CHAIN}, ep AS (SELECT *, ['single', 'multi', 'no_tool', 'clarify', 'error', 'chain'][1 + key % 6] AS kind,
  {S.draw(scripted.SEED, "'kinds'", 'key')} % 6 AS act FROM mol),
res AS (SELECT key AS episode, kind,
  CASE WHEN act = 2 THEN 0 WHEN act = 3 THEN 6
   WHEN act = 4 THEN CASE kind WHEN 'multi' THEN 2 WHEN 'chain' THEN 2 ELSE 1 END
   ELSE CASE kind WHEN 'multi' THEN 2 WHEN 'chain' THEN 2 WHEN 'single' THEN 1 WHEN 'error' THEN 1 ELSE 0 END END AS n_calls,
  CASE WHEN act = 2 THEN kind = 'no_tool' WHEN act = 3 THEN false
   WHEN kind IN ('no_tool', 'clarify') THEN act <> 4 AND (kind = 'no_tool' OR act <> 1)
   WHEN kind = 'chain' THEN act NOT IN (1, 4) ELSE act <> 1 END AS correct,
  CASE WHEN act = 2 THEN kind IN ('no_tool', 'clarify') WHEN act = 3 THEN kind IN ('single', 'error')
   WHEN kind IN ('no_tool', 'clarify') THEN act <> 4 WHEN kind = 'chain' THEN act <> 4 ELSE true END AS tool_valid FROM ep)"""


@query(_KINDS + " SELECT episode, kind, n_calls, correct, tool_valid FROM res")
def episode_by_kind(spark, d):
    episodes, turns = scripted.kind_episodes(read(spark, d, "part"))
    return E.score_by_kind(episodes, turns).select("episode", "kind", "n_calls", "correct", "tool_valid")


_BENCH_RES = f"""WITH {_CHAIN}, ep AS (SELECT key, ['paraphrase', 'multi', 'no_tool'][1 + key % 3] AS kind, t, {S.draw(scripted.SEED, "'bench'", 'key')} % 4 AS act FROM mol),
res AS (SELECT key AS episode, kind,
  CASE WHEN act = 2 THEN 0 WHEN kind = 'multi' THEN 2 WHEN kind = 'paraphrase' THEN 1 WHEN act = 3 THEN 1 ELSE 0 END AS n_calls,
  -- A wrong count of donors is covered by the count of rings where both are zero.
  CASE WHEN act = 2 THEN false WHEN act = 1 THEN kind = 'multi' AND t = 0 WHEN kind = 'no_tool' THEN act <> 3 ELSE true END AS correct,
  CASE WHEN kind = 'no_tool' THEN act <> 3 ELSE act <> 2 END AS tool_valid FROM ep)"""


@query(_BENCH_RES + " SELECT episode, kind, n_calls, correct, tool_valid FROM res")
def hard_benchmark_scores(spark, d):
    episodes, turns = scripted.bench_episodes(read(spark, d, "part"))
    return E.score_general(episodes, turns).select("episode", "kind", "n_calls", "correct", "tool_valid")


_KINDS_V2 = _KINDS.replace("FROM ep)", "FROM ep WHERE kind <> 'chain')")


@query(_KINDS_V2 + " SELECT episode, kind, n_calls, correct, tool_valid FROM res")
def episode_by_kind_v2(spark, d):
    episodes, turns = scripted.kind_episodes(read(spark, d, "part"))
    return E.score_by_kind(episodes.where("kind <> 'chain'"), turns, 2).select("episode", "kind", "n_calls", "correct", "tool_valid")


@query(_KINDS + _METRICS.format(k="kind"))
def metrics_by_kind(spark, d):
    episodes, turns = scripted.kind_episodes(read(spark, d, "part"))
    return A.report_order(A.metrics(E.score_by_kind(episodes, turns), "kind"))


@query(f"WITH {_CHAIN} SELECT smiles, n::BIGINT AS n, prop, {_LABEL.format(n='n')} AS value FROM (SELECT DISTINCT smiles, n, t FROM mol), "
       + S.values([(p,) for p in scripted.PROPS_NATIVE], "prop"))
def chain_molecule_labels(spark, d):
    mols = scripted.chain_molecules(read(spark, d, "part")).select("smiles", (F.col("key") % 9 + 1).alias("n")).distinct()
    rows = mols.withColumn("prop", F.explode(F.array(*[F.lit(p) for p in scripted.PROPS_NATIVE])))
    return scripted.labelled(rows, "smiles", "prop", "value").select("smiles", "n", "prop", "value")


@query("""SELECT n, smiles, n::INT AS heavy_atoms, 1 AS ring_count, 'C' || n || 'H' || (2 * n) AS formula, round(n * 14.027, 4)::DOUBLE AS mw, n >= 3 AS accepted
 FROM (SELECT DISTINCT 3 + p_partkey % 7 AS n, 'C1' || repeat('C', (1 + p_partkey % 7)::INT) || 'C1' AS smiles FROM part)""")
def ring_molecules(spark, d):
    n = F.col("p_partkey") % 7 + 3
    smiles = F.concat(F.lit("C1"), F.repeat(F.lit("C"), (F.col("p_partkey") % 7 + 1).cast("int")), F.lit("C1"))
    rows = with_features(read(spark, d, "part").select(n.alias("n"), smiles.alias("smiles")).distinct())
    f = lambda k: F.col(f"features.{k}").alias(k)
    return rows.select("n", "smiles", f("heavy_atoms"), f("ring_count"), f("formula"), f("mw"), M.accepted().alias("accepted"))


@query("""SELECT p_partkey, smiles, k = 0 AS validity, k = 0 AND n >= 3 AS accepted FROM (SELECT p_partkey, 1 + p_partkey % 9 AS n, p_size % 4 AS k,
 repeat('C', (1 + p_partkey % 9)::INT) || ['', '(', '1', ')'][1 + p_size % 4] AS smiles FROM part)""")
def broken_molecules(spark, d):
    tail = F.element_at(F.array(F.lit(""), F.lit("("), F.lit("1"), F.lit(")")), (F.col("p_size") % 4 + 1).cast("int"))
    smiles = F.concat(F.repeat(F.lit("C"), (F.col("p_partkey") % 9 + 1).cast("int")), tail)
    rows = with_features(read(spark, d, "part").select("p_partkey", smiles.alias("smiles")))
    return rows.select("p_partkey", "smiles", F.col("features.validity").alias("validity"), M.accepted().alias("accepted"))


# --- sources and sinks ---------------------------------------------------------------------------------------------------


@query("SELECT smiles, count(*) AS n FROM molecules GROUP BY smiles")
def scan_sources(spark, d):
    """Molecules written as CSV, Parquet and JSON lines and read by the three registered sources, which agree."""
    mols, folder = read(spark, d, "molecules").select("pos", "smiles"), scratch(spark)
    mols.write.option("header", True).csv(f"{folder}/csv")
    mols.write.parquet(f"{folder}/parquet")
    mols.write.json(f"{folder}/json")
    every = scan(spark, "csv", f"{folder}/csv").union(scan(spark, "parquet", f"{folder}/parquet")).union(scan(spark, "json", f"{folder}/json"))
    return every.groupBy("smiles").agg(F.count(F.lit(1)).alias("times")).where("times % 3 = 0").select("smiles", (F.col("times") / 3).cast("bigint").alias("n"))


@query("""SELECT split, kind, question, CASE WHEN kind <> 'multi' THEN smiles END AS smiles, CASE WHEN kind <> 'multi' THEN prop END AS prop, coalesce(len(pairs), 0)::INT AS n_pairs, name, answer, clarify_text
 FROM qa_v3 WHERE kind IN ('single', 'error', 'multi', 'chain', 'no_tool', 'clarify')""")
def rows_round_trip(spark, d):
    """Question rows written as JSON lines by split and read again."""
    rows, folder = read(spark, d, "qa_v3").where(F.col("kind").isin("single", "error", "multi", "chain", "no_tool", "clarify")), scratch(spark)
    write_rows(rows.withColumn("pairs", F.transform("pairs", lambda p: F.array(p["smiles"], p["prop"]))), folder)
    back = read_rows(spark, folder, "train").unionByName(read_rows(spark, folder, "val")).unionByName(read_rows(spark, folder, "test"))
    n_pairs = F.coalesce(F.when(F.col("pairs").isNotNull(), F.size("pairs")), F.lit(0)).alias("n_pairs")
    return back.select("split", "kind", "question", "smiles", "prop", n_pairs, "name", "answer", "clarify_text")


@query("SELECT name, min(smiles) AS smiles FROM name_dict GROUP BY name")
def dictionary_round_trip(spark, d):
    """A dictionary with every name given twice, collapsed, written as one JSON object and read again."""
    names, folder = read(spark, d, "name_dict").select("name", "smiles"), scratch(spark)
    one = J.one_per_name(names.unionByName(names))
    one.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "smiles")))).alias("value")).coalesce(1).write.text(folder)
    return read_dictionary(spark, folder)


@query("SELECT kind, count(*) AS n FROM qa_v3 WHERE kind IN ('no_tool', 'clarify', 'multi', 'error', 'single') AND (kind NOT IN ('single', 'error') OR prop IN ("
       + ", ".join(S.lit(x) for x in C.ALL_PROPERTIES) + ")) GROUP BY kind")
def load_trace_table(spark, d):
    """JSON-lines rows loaded as a trainer's table; the counts by kind, for kinds whose traces have as many messages as they should."""
    rows, folder = read(spark, d, "qa_v3").where(F.col("kind").isin("no_tool", "clarify", "multi", "error", "single")), scratch(spark)
    rows = rows.where(~F.col("kind").isin("single", "error") | F.col("prop").isin(*C.ALL_PROPERTIES))
    write_rows(rows.withColumn("pairs", F.transform("pairs", lambda p: F.array(p["smiles"], p["prop"]))).withColumn("split", F.lit("train")), folder)
    table, counts = evaluate.load_traces(spark, f"{folder}/split=train", read(spark, d, "name_dict"))
    n = F.size("messages")
    kind = F.when(n == 3, "asked").when(n == 5, "one call").otherwise("more calls")
    sizes = table.groupBy(kind.alias("size")).agg(F.count(F.lit(1)).alias("m"))
    expected = counts.groupBy(F.when(F.col("kind").isin("no_tool", "clarify"), "asked").when(F.col("kind") == "multi", "more calls").otherwise("one call").alias("size")).agg(F.sum("n").alias("m"))
    right = expected.join(sizes, ["size", "m"], "left_semi")
    return counts.join(right, F.col("size") == F.when(F.col("kind").isin("no_tool", "clarify"), "asked").when(F.col("kind") == "multi", "more calls").otherwise("one call")).select("kind", "n")


@query(f"""WITH {_CHAIN} SELECT key, '{{"result": ' || CASE WHEN t = 0 THEN '0' ELSE '1' END || '}}' AS told, '{{"error": "unknown name"}}' AS found FROM mol""")
def registered_tools(spark, d):
    """The tools as SQL functions."""
    evaluate.register_tools(spark, {"water": "O"})
    mols = scripted.chain_molecules(read(spark, d, "part"))
    return mols.selectExpr("key", f"{C.COMPUTE_TOOL}(smiles, 'hbd') as told", f"{C.NAME_TOOL}('no such name') as found")


@query(f"SELECT pos, smiles FROM molecules ORDER BY {S.draw(SEED, chr(39) + 'shuffle' + chr(39), 'pos')}, pos LIMIT 100")
def shuffled_head(spark, d):
    """The first hundred molecules of a seeded shuffle."""
    return R.shuffled(read(spark, d, "molecules").select("pos", "smiles"), SEED, "pos").limit(100)


@query("SELECT row_id, question FROM (SELECT DISTINCT row_id, question FROM qa_v3) ORDER BY row_id LIMIT 50")
def head_rows(spark, d):
    return A.head(read(spark, d, "qa_v3").select("row_id", "question").distinct(), "row_id", 50)


# --- molecules in closed form ----------------------------------------------------------------------------------------------

_LOGP = "round(CASE t WHEN 0 THEN n * 0.1441 + (2 * n + 2) * 0.123 WHEN 1 THEN (n - 1) * 0.1441 - 0.2035 - 0.2893 - 0.2677 + (2 * n + 1) * 0.123 ELSE (n - 1) * 0.1441 - 0.2035 - 1.019 + 2 * 0.2142 + (2 * n + 1) * 0.123 END, 4)::DOUBLE"


@query(f"""WITH {_CHAIN} SELECT smiles, {_LOGP} AS logp, CASE t WHEN 0 THEN 0.0 WHEN 1 THEN 20.23 ELSE 26.02 END::DOUBLE AS tpsa, CASE t WHEN 0 THEN 0 ELSE 1 END AS hba,
 true AS lipinski, true AS veber, 0 AS num_stereocenters, '' AS scaffold FROM (SELECT DISTINCT smiles, n, t FROM mol)""")
def chain_molecule_features(spark, d):
    rows = with_features(scripted.chain_molecules(read(spark, d, "part")).select("smiles").distinct())
    return rows.select("smiles", *[F.col(f"features.{k}").alias(k) for k in ("logp", "tpsa", "hba", "lipinski", "veber", "num_stereocenters", "scaffold")])


_LONG = "SELECT p_partkey AS key, repeat('C', (1 + p_partkey % 40)::INT) AS smiles, 1 + p_partkey % 40 AS n FROM part"


@query(f"SELECT key, smiles FROM ({_LONG}) WHERE n BETWEEN 3 AND 60 AND n * 12.011 + (2 * n + 2) * 1.008 BETWEEN 150 AND 500 AND n * 0.1441 + (2 * n + 2) * 0.123 <= 5")
def drug_like_chains(spark, d):
    smiles = F.repeat(F.lit("C"), (F.col("p_partkey") % 40 + 1).cast("int"))
    rows = with_features(read(spark, d, "part").select(F.col("p_partkey").alias("key"), smiles.alias("smiles")))
    return rows.where(M.accepted(drug_like=True)).select("key", "smiles")


@query("""SELECT 'C' || repeat('C', (p_size % 7)::INT) || 'O' AS canonical, min(p_partkey) AS key FROM part GROUP BY p_size % 7""")
def canonical_dedupe_chains(spark, d):
    """Alcohols written from either end or from the middle; one row a molecule, the first."""
    k, way = (F.col("p_size") % 7).cast("int"), F.col("p_partkey") % 3
    body = F.repeat(F.lit("C"), k)
    smiles = F.when(way == 0, F.concat(F.lit("C"), body, F.lit("O"))).when(way == 1, F.concat(F.lit("OC"), body)).otherwise(F.concat(F.lit("C(O)"), body))
    rows = with_features(read(spark, d, "part").select(F.col("p_partkey").alias("key"), smiles.alias("smiles")))
    return M.first_wins(rows.select(F.col("features.canonical").alias("canonical"), "key"), "canonical", "key")


@query("""SELECT p_partkey AS key, p_partkey % 4 IN (0, 3) AS same, 0 AS centres FROM part""")
def double_bond_forms(spark, d):
    """Pairs of spellings of 1-fluoro-alkenes: the same form twice, or both forms."""
    tail = F.repeat(F.lit("C"), (F.col("p_size") % 6 + 1).cast("int"))
    a = F.concat(F.lit("F/C=C/"), tail)
    b = F.element_at(F.array(
        F.concat(F.lit("F\\C=C\\"), tail), F.concat(F.lit("F/C=C\\"), tail), F.concat(F.lit("FC=C"), tail), F.concat(F.lit("C(\\F)=C/"), tail)), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = scripted.labelled_all(
        read(spark, d, "part").select(F.col("p_partkey").alias("key"), a.alias("a"), b.alias("b"), F.lit("canonical").alias("p"), F.lit("num_stereocenters").alias("q")),
        ("a", "p", "ca"), ("b", "p", "cb"), ("a", "q", "n"),
    )
    return rows.select("key", (F.col("ca") == F.col("cb")).alias("same"), F.col("n").cast("int").alias("centres"))


_RINGS = "WITH r AS (SELECT p_partkey AS pos, 3 + p_partkey % 6 AS n, 'C1' || repeat('C', (1 + p_partkey % 6)::INT) || 'C1' AS g FROM part), "


@query(_RINGS + _SPLIT_TEXT.format(h=S.draw(SEED, "'group'", "g"), rows="r") + " SELECT pos, g AS scaffold, split FROM r JOIN named USING (g)")
def scaffold_split_rings(spark, d):
    """Rings with side chains, split by their scaffold, the bare ring."""
    ring = F.concat(F.lit("C1"), F.repeat(F.lit("C"), (F.col("p_partkey") % 6 + 1).cast("int")), F.lit("C1"))
    smiles = F.concat(ring, F.repeat(F.lit("C"), (F.col("p_size") % 5).cast("int")))
    rows = with_features(read(spark, d, "part").select(F.col("p_partkey").alias("pos"), smiles.alias("smiles")))
    return M.group_split(rows.select("pos", F.col("features.scaffold").alias("scaffold")), "scaffold", SEED)


# --- parsing ------------------------------------------------------------------------------------------------------------


def _v1_texts(spark, d):
    s, k = F.col("smiles"), F.col("pos") % 8
    good = F.concat(F.lit('Sure. TOOL_CALL: {"smiles": "'), s, F.lit('", "property": " MW"} then'))
    text = (
        F.when(k == 0, good).when(k == 1, F.concat(F.lit('TOOL_CALL:\n {"property": "hbd", "smiles": "'), s, F.lit('"}')))
        .when(k == 2, F.concat(F.lit('TOOL_CALL: {"smiles": "'), s, F.lit('"}')))
        .when(k == 3, F.concat(F.lit('TOOL_CALL: {"smiles": "'), s, F.lit('", "property": "color"}')))
        .when(k == 4, F.concat(F.lit('TOOL_CALL: {"args": {"smiles": "'), s, F.lit('"}}')))
        .when(k == 5, F.concat(F.lit("TOOL_CALL: {smiles: "), s, F.lit("}")))
        .when(k == 6, F.concat(good, F.lit(' TOOL_CALL: {"smiles": "C", "property": "hba"}'))).otherwise(F.lit("no call {here}"))
    )
    return read(spark, d, "molecules").select("pos", text.alias("text"))


_V1_TEXT = """SELECT pos, smiles, pos % 8 AS k, CASE pos % 8
 WHEN 0 THEN 'Sure. TOOL_CALL: {"smiles": "' || smiles || '", "property": " MW"} then'
 WHEN 1 THEN 'TOOL_CALL:' || chr(10) || ' {"property": "hbd", "smiles": "' || smiles || '"}'
 WHEN 2 THEN 'TOOL_CALL: {"smiles": "' || smiles || '"}' WHEN 3 THEN 'TOOL_CALL: {"smiles": "' || smiles || '", "property": "color"}'
 WHEN 4 THEN 'TOOL_CALL: {"args": {"smiles": "' || smiles || '"}}' WHEN 5 THEN 'TOOL_CALL: {smiles: ' || smiles || '}'
 WHEN 6 THEN 'Sure. TOOL_CALL: {"smiles": "' || smiles || '", "property": " MW"} then TOOL_CALL: {"smiles": "C", "property": "hba"}'
 ELSE 'no call {here}' END AS text FROM molecules"""


@query(f"""WITH t AS ({_V1_TEXT}), c AS (SELECT pos, regexp_extract(text, '(?s)TOOL_CALL:\\s*(\\{{.*?\\}})', 1) AS j FROM t),
 p AS (SELECT pos, json_extract_string(j, '$.smiles') AS smiles, lower(trim(json_extract_string(j, '$.property'))) AS prop FROM c WHERE json_valid(j))
 SELECT t.pos, CASE WHEN ok THEN p.smiles END AS smiles, CASE WHEN ok THEN p.prop END AS prop FROM t LEFT JOIN
 (SELECT *, smiles IS NOT NULL AND prop IN ({', '.join(S.lit(x) for x in C.V1_PROPERTIES)}) AS ok FROM p) p ON p.pos = t.pos""")
def parse_v1_calls(spark, d):
    call = P.parse_v1_call(F.col("text"))
    return _v1_texts(spark, d).select("pos", call["smiles"].alias("smiles"), call["prop"].alias("prop"))


_NATIVE_TEXT = f"""SELECT pos, CASE pos % 10
 WHEN 0 THEN 'ok <tool_call>{{"name": "{C.COMPUTE_TOOL}", "arguments": {{"smiles": "' || smiles || '", "property": "TPSA "}}}}</tool_call>'
 WHEN 1 THEN '<tool_call>' || chr(10) || '{{"name": "{C.NAME_TOOL}", "arguments": {{"name": "mol ' || pos || '"}}}}' || chr(10) || '</tool_call>'
 WHEN 2 THEN '<tool_call>{{"name": "other", "arguments": {{"smiles": "' || smiles || '"}}}}</tool_call>'
 WHEN 3 THEN '<tool_call>{{"name": "{C.COMPUTE_TOOL}", "arguments": {{"smiles": "' || smiles || '", "property": "hue"}}}}</tool_call>'
 WHEN 4 THEN '<tool_call>{{"name": "{C.COMPUTE_TOOL}", "arguments": {{"smiles": "' || smiles || '"}}</tool_call>'
 WHEN 5 THEN '<tool_call>{{"name": "{C.COMPUTE_TOOL}", "arguments": "none"}}</tool_call>'
 WHEN 6 THEN '<tool_call>{{"name": "{C.NAME_TOOL}", "arguments": "{{\\"name\\": \\"x\\"}}"}}</tool_call>'
 WHEN 7 THEN '<tool_call>{{"name": "{C.NAME_TOOL}", "arguments": {{"name": "mol ' || pos || '"}}}} {{}}</tool_call>'
 WHEN 8 THEN '<tool_call>{{"name": "{C.COMPUTE_TOOL}", "arguments": {{"smiles": null, "property": "mw"}}}}</tool_call>'
 ELSE 'The answer is 3.' END AS text FROM molecules"""


def _native_texts(spark, d):
    s, k = F.col("smiles"), F.col("pos") % 10
    head = f'<tool_call>{{"name": "{C.COMPUTE_TOOL}", "arguments": {{"smiles": "'
    text = (
        F.when(k == 0, F.concat(F.lit("ok " + head), s, F.lit('", "property": "TPSA "}}</tool_call>')))
        .when(k == 1, F.concat(F.lit(f'<tool_call>\n{{"name": "{C.NAME_TOOL}", "arguments": {{"name": "mol '), F.col("pos"), F.lit('"}}\n</tool_call>')))
        .when(k == 2, F.concat(F.lit('<tool_call>{"name": "other", "arguments": {"smiles": "'), s, F.lit('"}}</tool_call>')))
        .when(k == 3, F.concat(F.lit(head), s, F.lit('", "property": "hue"}}</tool_call>')))
        .when(k == 4, F.concat(F.lit(head), s, F.lit('"}</tool_call>')))
        .when(k == 5, F.lit(f'<tool_call>{{"name": "{C.COMPUTE_TOOL}", "arguments": "none"}}</tool_call>'))
        .when(k == 6, F.lit(f'<tool_call>{{"name": "{C.NAME_TOOL}", "arguments": "{{\\"name\\": \\"x\\"}}"}}</tool_call>'))
        .when(k == 7, F.concat(F.lit(f'<tool_call>{{"name": "{C.NAME_TOOL}", "arguments": {{"name": "mol '), F.col("pos"), F.lit('"}} {}</tool_call>')))
        .when(k == 8, F.lit(f'<tool_call>{{"name": "{C.COMPUTE_TOOL}", "arguments": {{"smiles": null, "property": "mw"}}}}</tool_call>'))
        .otherwise(F.lit("The answer is 3."))
    )
    return read(spark, d, "molecules").select("pos", text.alias("text"))


@query(f"""WITH t AS ({_NATIVE_TEXT}), c AS (SELECT pos, text, regexp_extract(text, '(?s)<tool_call>\\s*(\\{{.*?\\}})\\s*</tool_call>', 1) AS j FROM t),
 p AS (SELECT pos, text, json_extract_string(v, '$.name') AS tool, CASE WHEN json_type(v, '$.arguments.smiles') = 'NULL' THEN 'None' ELSE json_extract_string(v, '$.arguments.smiles') END AS smiles,
  lower(trim(json_extract_string(v, '$.arguments.property'))) AS prop, json_extract_string(v, '$.arguments.name') AS name
  FROM (SELECT *, CASE WHEN json_valid(j) THEN j END AS v FROM c)),
 q AS (SELECT *, coalesce(tool = '{C.COMPUTE_TOOL}' AND smiles IS NOT NULL AND prop IN ({', '.join(S.lit(x) for x in C.ALL_PROPERTIES)}), false) AS a,
  coalesce(tool = '{C.NAME_TOOL}' AND name IS NOT NULL, false) AS b FROM p)
 SELECT pos, CASE WHEN a OR b THEN tool END AS tool, CASE WHEN a THEN smiles END AS smiles, CASE WHEN a THEN prop END AS prop,
  CASE WHEN b THEN name END AS name, contains(text, '<tool_call>') AND NOT a AND NOT b AS broken FROM q""")
def parse_native_calls(spark, d):
    call = P.parse_native_call(F.col("text"))
    broken = P.is_broken_call(F.col("text")).alias("broken")
    return _native_texts(spark, d).select("pos", *[call[k].alias(k) for k in ("tool", "smiles", "prop", "name")], broken)


@query("""SELECT doc_id, nullif(trim(regexp_extract(said, 'FINAL:\\s*([^\\n]*)', 1)), '') AS final, len(list_filter(regexp_split_to_array(said, '[\\s,;:=]+'), lambda x: x <> ''))::INT AS n_tokens,
 contains(lower(said), 'cannot') OR contains(lower(said), 'invalid') OR contains(lower(said), 'error') OR contains(lower(said), 'couldn''t')
  OR contains(lower(said), 'can''t') OR contains(lower(said), 'unable') OR contains(lower(said), 'unknown') AS reports_failure
 FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'FINAL: ' || source || ' ' WHEN 1 THEN source || '=1, x:2; FINAL:' || chr(10) || chr(10) || '  ' || lang || chr(10) || 'tail'
  ELSE 'I cannot say, ' || source END AS said FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)""")
def parse_finals(spark, d):
    k = F.col("doc_id") % 3
    said = (
        F.when(k == 0, F.concat(F.lit("FINAL: "), "source", F.lit(" ")))
        .when(k == 1, F.concat("source", F.lit("=1, x:2; FINAL:\n\n  "), "lang", F.lit("\ntail"))).otherwise(F.concat(F.lit("I cannot say, "), "source"))
    )
    rows = read(spark, d, "documents").where("source is not null and lang is not null").select("doc_id", said.alias("said"))
    s = F.col("said")
    return rows.select("doc_id", P.parse_final(s).alias("final"), F.size(P.tokens(s)).alias("n_tokens"), P.contains_any(s, C.ERROR_WORDS[3]).alias("reports_failure"))


# --- scoring ------------------------------------------------------------------------------------------------------------

_SPELL = "[value::VARCHAR, (value + 0.05)::VARCHAR, (value + 0.5)::VARCHAR, 'nan', '1d', ' ' || value::VARCHAR || ' ', 'x', 'inf'][1 + event_id % 8]"


@query(f"""SELECT event_id, coalesce(CASE WHEN regexp_full_match(trim(p), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
 THEN abs(trim(p)::DOUBLE - value) <= 0.1 ELSE false END, false) AS correct FROM (SELECT event_id, value, {_SPELL} AS p FROM events)""")
def score_floats(spark, d):
    v = F.col("value")
    told = F.element_at(F.array(
        v.cast("string"), (v + 0.05).cast("string"), (v + 0.5).cast("string"), F.lit("nan"), F.lit("1d"), F.concat(F.lit(" "), v.cast("string"), F.lit(" ")),
        F.lit("x"), F.lit("inf")), (F.col("event_id") % 8 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", scoring.score(F.lit("float"), F.lit(0.1), told, v.cast("string")).alias("correct"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN regexp_full_match(trim(p), '[+-]?[0-9]+') THEN trim(p)::BIGINT = o_custkey ELSE false END, false) AS correct,
 CASE WHEN p IN ('Yes', 'pass', '1') THEN true WHEN p IN ('no', 'FAILS', '0') THEN false END AS said
 FROM (SELECT o_orderkey, o_custkey, [o_custkey::VARCHAR, o_custkey::VARCHAR || '.0', ' +' || o_custkey::VARCHAR, '0' || o_custkey::VARCHAR, 'Yes', 'no', 'pass', 'FAILS', '1', '0'][1 + o_orderkey % 10] AS p FROM orders)""")
def score_ints_and_bools(spark, d):
    c = F.col("o_custkey").cast("string")
    told = F.element_at(F.array(c, F.concat(c, F.lit(".0")), F.concat(F.lit(" +"), c), F.concat(F.lit("0"), c), *[F.lit(x) for x in ("Yes", "no", "pass", "FAILS", "1", "0")]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    right = scoring.score(F.lit("int"), F.lit(None).cast("double"), told, c)
    return read(spark, d, "orders").select("o_orderkey", right.alias("correct"), scoring.as_bool(told).alias("said"))


@query("""SELECT p_partkey, upper(trim(told)) = upper(truth) AS correct, list_contains(regexp_split_to_array(said, '[\\s,;:=]+'), p_size::VARCHAR) AS covered
 FROM (SELECT p_partkey, p_size, p_brand AS truth, [lower(p_brand), ' ' || p_brand || ' ', p_brand || '!', p_name][1 + p_partkey % 4] AS told,
 ['size=' || p_size || ', ok', 'about ' || p_size || 'x', 'rings: ' || p_size, 'none'][1 + p_partkey % 4] AS said FROM part)""")
def score_texts_and_coverage(spark, d):
    b, n, k = F.col("p_brand"), F.col("p_size").cast("string"), (F.col("p_partkey") % 4 + 1).cast("int")
    told = F.element_at(F.array(F.lower(b), F.concat(F.lit(" "), b, F.lit(" ")), F.concat(b, F.lit("!")), F.col("p_name")), k)
    said = F.element_at(F.array(F.concat(F.lit("size="), n, F.lit(", ok")), F.concat(F.lit("about "), n, F.lit("x")), F.concat(F.lit("rings: "), n), F.lit("none")), k)
    none = F.lit(None).cast("double")
    return read(spark, d, "part").select(
        "p_partkey", scoring.score(F.lit("str_exact"), none, told, b).alias("correct"), scoring.final_covers(F.lit("int"), none, said, n).alias("covered")
    )


# --- molecules: dedupe, split, checks -----------------------------------------------------------------------------------

_WIDE_FROM = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)).replace("'", "''")
_WIDE_TO = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_PLAIN = (
    "regexp_replace(regexp_replace(translate(smiles, '" + _WIDE_FROM + "', '" + _WIDE_TO + "'), '[\\s\\p{Z}\\x{85}\\p{Cf}]', '', 'g'), "
    "'^[\"''<`]+|[\"''>`]+$', '', 'g')"
)


@query(f"""WITH k AS (SELECT raw_id, source, nullif({_PLAIN}, '') AS spelling FROM raw_molecules)
 SELECT spelling, raw_id, source FROM (SELECT *, row_number() OVER (PARTITION BY spelling ORDER BY raw_id) AS r FROM k WHERE spelling IS NOT NULL)
 WHERE r = 1 ORDER BY raw_id LIMIT 1000""")
def first_wins_dedupe(spark, d):
    rows = read(spark, d, "raw_molecules").select(plain_smiles("smiles").alias("spelling"), "raw_id", "source")
    return M.first_wins(rows, "spelling", "raw_id", 1000)


_SPLIT = _SPLIT_TEXT
_DOC_SPLIT = "WITH docs AS (SELECT doc_id, coalesce(source, '') AS g FROM documents), " + _SPLIT.format(h=S.draw(SEED, "'group'", "g"), rows="docs")


@query(_DOC_SPLIT + " SELECT doc_id, split FROM docs JOIN named USING (g)")
def group_split(spark, d):
    return M.group_split(read(spark, d, "documents").select("doc_id", "source"), "source", SEED).select("doc_id", "split")


@query(_DOC_SPLIT + """, s AS (SELECT g, list(DISTINCT split) AS s FROM docs JOIN named USING (g) WHERE g <> '' GROUP BY g)
 SELECT a AS split_a, b AS split_b, (SELECT count(*) FROM s WHERE list_contains(s, a) AND list_contains(s, b)) AS shared
 FROM (VALUES ('test', 'train'), ('test', 'val'), ('train', 'val')) AS v(a, b)""")
def split_leakage(spark, d):
    return M.split_overlaps(M.group_split(read(spark, d, "documents").select("doc_id", "source"), "source", SEED), "source")


@query("""WITH k AS (SELECT name, list(DISTINCT split) AS s FROM qa_v3 WHERE name IS NOT NULL GROUP BY name)
 SELECT a AS split_a, b AS split_b, (SELECT count(*) FROM k WHERE list_contains(s, a) AND list_contains(s, b)) AS shared
 FROM (VALUES ('test', 'train'), ('test', 'val'), ('train', 'val')) AS v(a, b)""")
def name_leakage(spark, d):
    return M.split_overlaps(read(spark, d, "qa_v3"), "name")


@query("SELECT pos, smiles, ['train', 'val', 'test'][1 + pos % 3] AS split FROM molecules")
def bank_partition(spark, d):
    return M.bank_split(read(spark, d, "molecules").select("pos", "smiles"), "pos")


@query()
def scaffold_split(spark, d):
    rows = with_features(read(spark, d, "molecules").select("pos", "smiles")).where(M.accepted())
    rows = rows.select("pos", "smiles", F.col("features.scaffold").alias("scaffold"))
    return M.group_split(rows, "scaffold", SEED)


@query()
def molecule_features(spark, d):
    table = features_of(read(spark, d, "raw_molecules").select(plain_smiles("smiles").alias("spelling")))
    return table.drop("qed", "pains_alert")


@query()
def canonical_dedupe(spark, d):
    rows = read(spark, d, "raw_molecules").select("raw_id", "source", plain_smiles("smiles").alias("smiles")).where("smiles is not null")
    rows = with_features(rows).where(M.accepted()).select(F.col("features.canonical").alias("canonical"), "raw_id", "source")
    return M.first_wins(rows, "canonical", "raw_id")


@query()
def drug_like(spark, d):
    rows = with_features(read(spark, d, "molecules").select("pos", "smiles"))
    return rows.where(M.accepted(drug_like=True)).select("pos", "smiles", "features.mw", "features.logp", "features.hbd", "features.hba")


# --- names --------------------------------------------------------------------------------------------------------------


@query("""SELECT q.row_id, q.name, d.smiles AS resolved FROM (SELECT DISTINCT row_id, name FROM qa_v3 WHERE name IS NOT NULL) q
 LEFT JOIN name_dict d ON d.name = lower(regexp_replace(q.name, '^[\\s\\p{Z}\\x{1C}-\\x{1F}\\x{85}]+|[\\s\\p{Z}\\x{1C}-\\x{1F}\\x{85}]+$', '', 'g'))""")
def name_resolve(spark, d):
    rows = read(spark, d, "qa_v3").where("name is not null").select("row_id", "name").distinct()
    return J.resolve(rows, read(spark, d, "name_dict"))


@query("""SELECT DISTINCT q.name FROM qa_v3 q WHERE q.name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM name_dict d
 WHERE d.name = lower(regexp_replace(q.name, '^[\\s\\p{Z}\\x{1C}-\\x{1F}\\x{85}]+|[\\s\\p{Z}\\x{1C}-\\x{1F}\\x{85}]+$', '', 'g')))""")
def name_misses(spark, d):
    return J.unresolved(read(spark, d, "qa_v3").select("name"), read(spark, d, "name_dict")).distinct()


_NAMES = "names AS (SELECT name, ['train', 'val', 'test'][1 + (row_number() OVER (ORDER BY name COLLATE \"C\") - 1) % 3] AS split FROM (SELECT DISTINCT name FROM name_dict))"
_NAMES = _NAMES.replace(' COLLATE "C"', "")


@query(f"WITH {_NAMES} SELECT name, split FROM names")
def name_splits(spark, d):
    return R.name_splits(read(spark, d, "name_dict"))


# --- generators ---------------------------------------------------------------------------------------------------------


def _mol(spark, d):
    rows = read(spark, d, "molecules").select(F.col("pos").alias("key"), "smiles", F.concat_ws("/", "source", F.col("pos") % 50).alias("g"))
    return M.group_split(rows, "g", SEED).select("key", "smiles", "split")


def _mol_once(spark, d):
    """Written once where several fan-outs read it; each would split the molecules anew."""
    return cut(_mol(spark, d))


_MOLS = ("m0 AS (SELECT pos AS key, smiles, concat_ws('/', source, pos % 50) AS g FROM molecules), "
         + _SPLIT.format(h=S.draw(SEED, "'group'", "g"), rows="m0") + ", mol AS (SELECT key, smiles, split FROM m0 JOIN named USING (g))")
_OUT = "{split} AS split, '{kind}' AS kind, {question} AS question, {smiles} AS smiles, {prop} AS prop, {prop2} AS prop2, {name} AS name, {answer} AS answer, {clarify} AS clarify_text"
_GOOD = [p for p in C.ALL_PROPERTIES if p != "validity"]


def _out(kind, question, **k):
    base = dict.fromkeys(("smiles", "prop", "prop2", "name", "answer", "clarify"), "NULL::VARCHAR") | {"split": "split"} | k
    return _OUT.format(kind=kind, question=question, **base)


def _corrupt(*keys):
    return (f"left(smiles, ({S.draw(SEED, chr(39) + 'at' + chr(39), *keys)} % length(smiles))::INT) || substr('{C.CORRUPTION}', (1 + {S.draw(SEED, chr(39) + 'mark' + chr(39), *keys)} % 8)::INT, 1)"
            f" || substr(smiles, ({S.draw(SEED, chr(39) + 'at' + chr(39), *keys)} % length(smiles) + 2)::INT)")  # fmt: skip


_SINGLE_SQL = (f"SELECT {_out('single', S.phrase(C.TEMPLATES, 'prop', '{smiles}', 'smiles', SEED, chr(39) + 'single' + chr(39), 'key', 'prop'), smiles='smiles', prop='prop')} "
               f"FROM mol, {S.values([(p,) for p in C.ALL_PROPERTIES], 'prop')}")  # fmt: skip
_ERROR_SQL = (f"SELECT {_out('error', S.phrase(C.TEMPLATES, 'prop', '{smiles}', 'bad', SEED, chr(39) + 'error' + chr(39), 'key'), smiles='bad', prop='prop')} FROM "
              f"(SELECT key, split, {S.pick(_GOOD, SEED, chr(39) + 'error prop' + chr(39), 'key')} AS prop, {_corrupt('key')} AS bad FROM mol WHERE {S.uniform(SEED, chr(39) + 'error?' + chr(39), 'key')} < {C.ERROR_RATE})")  # fmt: skip
_PAIR = S.pick([f"{a}|{b}" for a, b in C.PROPERTY_PAIRS], SEED, "'pair'", "key")
_MULTI_SQL = ("SELECT " + _out("multi", "'For ' || smiles || ', give the ' || replace(a, '_', ' ') || ' and the ' || replace(b, '_', ' ') || '.'", smiles="smiles", prop="a", prop2="b")
              + f" FROM (SELECT split, smiles, split_part(p, '|', 1) AS a, split_part(p, '|', 2) AS b FROM (SELECT *, {_PAIR} AS p FROM mol WHERE {S.uniform(SEED, chr(39) + 'multi?' + chr(39), 'key')} < {C.MULTI_RATE}))")
_PARTS = {s: [x for i, x in enumerate(C.CLARIFY_BANK) if i % 3 == k] for k, s in enumerate(("train", "val", "test"))}
_CLARIFY_Q = "CASE split " + " ".join(f"WHEN '{s}' THEN {S.pick(part, SEED, chr(39) + 'clarify' + chr(39), 'key')}" for s, part in _PARTS.items()) + " END"
_CLARIFY_SQL = f"SELECT {_out('clarify', _CLARIFY_Q, clarify=S.lit(C.CLARIFY_TEXT))} FROM mol WHERE {S.uniform(SEED, chr(39) + 'clarify?' + chr(39), 'key')} < {C.CLARIFY_RATE}"
_BANK_SQL = (f"SELECT {_out('no_tool', 'question', split='b.split', answer='answer')} FROM (SELECT ['train', 'val', 'test'][1 + pos % 3] AS split, question, answer FROM "
             + S.values([(i, q, a) for i, (q, a) in enumerate(C.BANK)], "pos", "question", "answer")
             + ") b LEFT JOIN (SELECT split, count(*) AS n FROM mol GROUP BY split) s ON s.split = b.split, range(5) r(i) WHERE i < greatest(1, least(5, coalesce(n, 0) // 500))")
_SUM_SQL = ("SELECT " + _out("no_tool", "'What is ' || a || ' plus ' || b || '?'", answer="(a + b)::VARCHAR")
            + f" FROM (SELECT split, {S.draw(SEED, chr(39) + 'a' + chr(39), 'key')} % 50 + 1 AS a, {S.draw(SEED, chr(39) + 'b' + chr(39), 'key')} % 50 + 1 AS b FROM mol)")
_CHAIN_SQL = (f"SELECT {_out('chain', S.phrase(C.NAME_TEMPLATES, 'prop', '{name}', 'name', SEED, chr(39) + 'chain' + chr(39), 'name', 'rep'), prop='prop', name='name')} FROM "
              f"(SELECT split, name, rep, {S.pick(_GOOD, SEED, chr(39) + 'chain prop' + chr(39), 'name', 'rep')} AS prop FROM (SELECT n.split, n.name, r.i AS rep FROM names n "
              "JOIN (SELECT split, count(*) AS nn FROM names GROUP BY split) a ON a.split = n.split LEFT JOIN (SELECT split, count(*) AS nm FROM mol GROUP BY split) b ON b.split = n.split, "
              f"range(1, 101) r(i) WHERE r.i <= greatest(1, least({C.CHAIN_REPEAT_CAP}, round_even(coalesce(nm, 0) / nn, 0)))))")  # fmt: skip


@query(f"WITH {_MOLS} {_SINGLE_SQL}")
def generate_single(spark, d):
    return R.single_rows(_mol(spark, d), C.ALL_PROPERTIES, SEED)


@query(f"WITH {_MOLS} {_ERROR_SQL}")
def generate_error(spark, d):
    return R.error_rows(_mol(spark, d), SEED)


@query(f"WITH {_MOLS} {_MULTI_SQL}")
def generate_multi(spark, d):
    return R.multi_rows(_mol(spark, d), SEED)


@query(f"WITH {_MOLS} {_CLARIFY_SQL}")
def generate_clarify(spark, d):
    return R.clarify_rows(_mol(spark, d), SEED)


@query(f"WITH {_MOLS} {_BANK_SQL} UNION ALL {_SUM_SQL}")
def generate_no_tool(spark, d):
    m = _mol(spark, d)
    return R.bank_rows(m).unionByName(R.arithmetic_rows(m, SEED))


@query(f"WITH {_MOLS}, {_NAMES} {_CHAIN_SQL}")
def generate_chain(spark, d):
    return R.chain_rows(R.name_splits(read(spark, d, "name_dict")), _mol(spark, d), SEED)


_BAD_V1 = "replace(" + S.lit(C.TEMPLATES["validity"][0]) + ", '{smiles}', bad)"
_V1_SQL = (f"SELECT {_out('single', S.phrase({p: t[:1] for p, t in C.TEMPLATES.items()}, 'prop', '{smiles}', 'smiles', SEED, chr(39) + 'single' + chr(39), 'key', 'prop'), smiles='smiles', prop='prop')} "
           f"FROM mol, {S.values([(p,) for p in C.V1_PROPERTIES], 'prop')} UNION ALL SELECT {_out('single', _BAD_V1, smiles='bad', prop=S.lit('validity'))} "
           f"FROM (SELECT split, {_corrupt('key')} AS bad FROM mol WHERE {S.uniform(SEED, chr(39) + 'corrupt?' + chr(39), 'key')} < {C.CORRUPT_RATE_V1})")  # fmt: skip


@query(f"WITH {_MOLS} {_V1_SQL}")
def generate_v1(spark, d):
    m = _mol(spark, d)
    return R.single_rows(m, C.V1_PROPERTIES, SEED, paraphrase=False).unionByName(R.corrupt_rows(m, SEED))


_ALL_V2 = f"{_SINGLE_SQL} UNION ALL {_ERROR_SQL} UNION ALL {_MULTI_SQL} UNION ALL {_CLARIFY_SQL} UNION ALL {_BANK_SQL} UNION ALL {_SUM_SQL}"


def _v2(spark, d, m):
    parts = [R.single_rows(m, C.ALL_PROPERTIES, SEED), R.error_rows(m, SEED), R.multi_rows(m, SEED), R.clarify_rows(m, SEED), R.bank_rows(m), R.arithmetic_rows(m, SEED)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {_MOLS} {_ALL_V2}")
def generate_v2(spark, d):
    return _v2(spark, d, _mol_once(spark, d))


def _v3(spark, d):
    m = _mol_once(spark, d)
    return _v2(spark, d, m).unionByName(R.chain_rows(R.name_splits(read(spark, d, "name_dict")), m, SEED))


@query(f"WITH {_MOLS}, {_NAMES} {_ALL_V2} UNION ALL {_CHAIN_SQL}")
def generate_v3(spark, d):
    return _v3(spark, d)


@query(f"WITH {_MOLS}, {_NAMES}, q AS ({_ALL_V2} UNION ALL {_CHAIN_SQL}) SELECT split, kind, count(*) AS n FROM q GROUP BY ALL")
def generated_kinds(spark, d):
    return A.kind_histogram(_v3(spark, d))


_BENCH_SQL = ("SELECT 'paraphrase' AS kind, replace(t, '{smiles}', smiles) AS question, smiles, prop, NULL::VARCHAR AS prop2, true AS expects_tool, NULL::VARCHAR AS answer FROM molecules, "
              + S.values([(p, C.TEMPLATES[p][1]) for p in C.V1_PROPERTIES], "prop", "t")
              + " UNION ALL SELECT 'multi', 'For ' || smiles || ', give the ' || replace(prop, '_', ' ') || ' and the ' || replace(prop2, '_', ' ') || '.', smiles, prop, prop2, true, NULL FROM molecules, "
              + S.values(C.PROPERTY_PAIRS[:5], "prop", "prop2")
              + " UNION ALL SELECT 'no_tool', question, NULL, NULL, NULL, false, answer FROM " + S.values(C.BENCH_NO_TOOL, "question", "answer"))


@query(_BENCH_SQL)
def hard_benchmark(spark, d):
    return R.bench_rows(read(spark, d, "molecules").select("smiles"))


@query(f"SELECT count(*) AS rows, count_if(kind = 'paraphrase')::BIGINT AS paraphrase, count_if(kind = 'multi')::BIGINT AS multi, count_if(kind = 'no_tool')::BIGINT AS no_tool FROM ({_BENCH_SQL})")
def benchmark_composition(spark, d):
    return A.composition(hard_benchmark(spark, d))


@query("""SELECT smiles, min(row_id) AS pos FROM qa_v3 WHERE split = 'test' AND smiles IS NOT NULL GROUP BY smiles ORDER BY pos LIMIT 15""")
def first_test_molecules(spark, d):
    rows = read(spark, d, "qa_v3").where("split = 'test'").select("smiles", F.col("row_id").alias("pos"))
    return M.first_wins(rows, "smiles", "pos", 15)


# --- histograms ---------------------------------------------------------------------------------------------------------


@query("SELECT split, kind, count(*) AS n FROM qa_v3 GROUP BY ALL")
def kind_histogram(spark, d):
    return A.kind_histogram(read(spark, d, "qa_v3"))


_KT = "nullif(trim(regexp_replace(lower(regexp_replace(translate(kind, '" + _WIDE_FROM + "', '" + _WIDE_TO + "'), '\\p{Cf}', '', 'g')), '[\\s\\p{Z}\\x{85}_\\-]+', ' ', 'g')), '')"


@query(f"SELECT kind, count(*) AS n, count(*) / (SELECT count(*) FROM qa_v3) AS fraction FROM (SELECT {_KT} AS kind FROM qa_v3) GROUP BY kind")
def kind_fractions(spark, d):
    return A.kind_fractions(read(spark, d, "qa_v3").select(term("kind").alias("kind")))


@query(f"""WITH f AS (SELECT kind, count(*) / (SELECT count(*) FROM qa_v3) AS fraction FROM (SELECT {_KT} AS kind FROM qa_v3) GROUP BY kind)
 SELECT step, kind, round_even(step * 16 * fraction, 0)::BIGINT AS seen FROM f, (VALUES (20), (40), (60)) v(step)""")
def kind_exposure(spark, d):
    return A.exposure(A.kind_fractions(read(spark, d, "qa_v3").select(term("kind").alias("kind"))), [20, 40, 60], 16)


@query("SELECT split, count(DISTINCT smiles) AS molecules, count(*) AS rows FROM qa_v3 GROUP BY split")
def split_summary(spark, d):
    return A.split_summary(read(spark, d, "qa_v3"))


@query("SELECT DISTINCT row_id, kind, smiles, prop FROM qa_v3 WHERE kind IN ('chain', 'single') AND prop = 'mw'")
def kind_and_property_filter(spark, d):
    return read(spark, d, "qa_v3").where(F.col("kind").isin("chain", "single") & (F.col("prop") == "mw")).select("row_id", "kind", "smiles", "prop").distinct()


@query("SELECT p.prop, vtype, tol, n FROM prop_list p LEFT JOIN (SELECT prop, count(*) AS n FROM qa_v3 GROUP BY prop) q ON q.prop = p.prop")
def property_metadata(spark, d):
    counts = read(spark, d, "qa_v3").groupBy("prop").agg(F.count(F.lit(1)).alias("n"))
    return read(spark, d, "prop_list").join(counts, "prop", "left").select("prop", "vtype", "tol", "n")


# --- traces, prompts, reward --------------------------------------------------------------------------------------------


def _long(rows: DataFrame, key: str, messages) -> DataFrame:
    """Messages one a row: ``(key, i, role, content, tool)``."""
    flat = rows.select(key, F.posexplode(messages).alias("i", "m"))
    return flat.select(key, "i", "m.role", "m.content", F.get("m.tool_calls", F.lit(0))["name"].alias("tool"))


def _asked(spark, d):
    q = read(spark, d, "qa_v3").where(F.col("kind").isin("no_tool", "clarify")).dropDuplicates(["row_id"])
    null = F.lit(None).cast("string")
    return q, T.native_trace(F.col("kind"), F.col("question"), T.steps_of((null, null, null)), null, null, F.col("answer"), F.col("clarify_text"))


@query(f"""WITH q AS (SELECT DISTINCT row_id, question, coalesce(answer, clarify_text) AS said FROM qa_v3 WHERE kind IN ('no_tool', 'clarify'))
 SELECT row_id, i, ['system', 'user', 'assistant'][1 + i] AS role, CASE i WHEN 0 THEN {S.lit(C.SYSTEM_PROMPT)} WHEN 1 THEN question ELSE said END AS content, NULL::VARCHAR AS tool
 FROM q, (VALUES (0), (1), (2)) v(i)""")
def trace_answers(spark, d):
    rows, messages = _asked(spark, d)
    return _long(rows, "row_id", messages)


def _labelled_parts(spark, d):
    rows = scripted.chain_molecules(read(spark, d, "part"))
    rows = rows.withColumns({"prop": F.lit("mw"), "prop2": F.lit("validity"), "name": F.concat(F.lit("chain "), F.col("key").cast("string"))})
    rows = rows.withColumn("kind", F.element_at(F.array(F.lit("single"), F.lit("multi"), F.lit("chain"), F.lit("error")), (F.col("key") % 4 + 1).cast("int")))
    rows = rows.withColumn("smiles", F.when(F.col("kind") == "error", F.concat("smiles", F.lit("("))).otherwise(F.col("smiles")))
    return scripted.labelled_all(rows, ("smiles", "prop", "value"), ("smiles", "prop2", "value2"))


def _part_messages(version: int = 3):
    c, null = F.col, F.lit(None).cast("string")
    one, two = (c("smiles"), c("prop"), c("value")), (c("smiles"), c("prop2"), c("value2"))
    steps = F.when(c("kind") == "multi", T.steps_of(one, two)).otherwise(T.steps_of(one))
    return T.native_trace(c("kind"), c("name"), steps, c("name"), c("smiles"), null, null, version)


_TRACE_MW = "(round(n * 12.011 + (2 * n + 2) * 1.008 + CASE t WHEN 1 THEN 15.999 WHEN 2 THEN 15.015 ELSE 0 END, 4))::DOUBLE::VARCHAR"


_TOOL_TRACE = f"""WITH {_CHAIN}, r AS (SELECT key, n, t, smiles, ['single', 'multi', 'chain', 'error'][1 + key % 4] AS kind, {_TRACE_MW} AS mw FROM mol),
 m AS (SELECT key, kind, unnest(['s', 'u'] || CASE kind
  WHEN 'single' THEN ['c', 'r:{{"result": ' || mw || '}}', 'a:' || mw]
  WHEN 'multi' THEN ['c', 'r:{{"result": ' || mw || '}}', 'c', 'r:{{"result": true}}', 'a:mw: ' || mw || ', validity: True']
  WHEN 'chain' THEN ['n', 'r:{{"result": "' || smiles || '"}}', 'c', 'r:{{"result": ' || mw || '}}', 'a:' || mw]
  ELSE ['c', 'r:{{"error": "invalid molecule"}}', 'a:' || {S.lit(C.ERROR_TEXT)}] END) AS x, generate_subscripts(CASE kind
  WHEN 'multi' THEN [1, 2, 3, 4, 5, 6, 7] WHEN 'chain' THEN [1, 2, 3, 4, 5, 6, 7] ELSE [1, 2, 3, 4, 5] END, 1) AS k FROM r)
 SELECT key, (k - 1)::INT AS i, CASE WHEN x = 's' THEN 'system' WHEN x = 'u' THEN 'user' WHEN left(x, 2) = 'r:' THEN 'tool' ELSE 'assistant' END AS role,
  CASE WHEN x = 's' THEN {S.lit(C.SYSTEM_PROMPT)} WHEN x = 'u' THEN 'chain ' || key WHEN left(x, 2) IN ('r:', 'a:') THEN substr(x, 3) END AS content,
  CASE x WHEN 'c' THEN '{C.COMPUTE_TOOL}' WHEN 'n' THEN '{C.NAME_TOOL}' END AS tool FROM m"""


@query(_TOOL_TRACE)
def trace_tool_messages(spark, d):
    return _long(_labelled_parts(spark, d), "key", _part_messages())


@query(_TOOL_TRACE + " WHERE kind <> 'chain'")
def trace_second_format(spark, d):
    return _long(_labelled_parts(spark, d).where("kind <> 'chain'"), "key", _part_messages(2))


_PAIRS_SQL = "SELECT row_id, generate_subscripts(pairs, 1) - 1 AS k, unnest(pairs) AS p FROM (SELECT DISTINCT ON (row_id) row_id, pairs FROM qa_v3 WHERE kind = 'multi' AND pairs IS NOT NULL)"


@query(f"""WITH p AS ({_PAIRS_SQL}) SELECT row_id, (2 + 2 * k)::INT AS i, p.smiles AS smiles, p.prop AS prop FROM p""")
def trace_multi_calls(spark, d):
    """The calls of the gold traces of all multi records: one a pair, each with its own SMILES."""
    rows = read(spark, d, "qa_v3").where("kind = 'multi' and pairs is not null").dropDuplicates(["row_id"])
    null = F.lit(None).cast("string")
    steps = F.transform("pairs", lambda p: F.struct(p["smiles"].alias("smiles"), p["prop"].alias("prop"), null.alias("value")))
    messages = T.native_trace(F.col("kind"), F.col("question"), steps, null, null, null, null)
    flat = rows.select("row_id", F.posexplode(messages).alias("i", "m")).where("m.tool_calls is not null")
    given = F.get("m.tool_calls", F.lit(0))["arguments"]
    return flat.select("row_id", "i", given["smiles"].alias("smiles"), given["property"].alias("prop"))


@query("""SELECT calls, count(*) AS n FROM (SELECT CASE key % 4 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS calls FROM (SELECT p_partkey AS key FROM part)) GROUP BY calls""")
def trace_call_histogram(spark, d):
    return A.calls_histogram(_labelled_parts(spark, d).select(_part_messages().alias("messages")))


@query(f"""WITH {_CHAIN} SELECT key, i, role, CASE i WHEN 0 THEN {S.lit(C.SYSTEM_PROMPT)} WHEN 1 THEN '?' WHEN 2 THEN 'TOOL_CALL: {{"smiles": "' || smiles || '", "property": "mw"}}' WHEN 3 THEN 'TOOL_RESULT: ' || mw ELSE 'FINAL: ' || mw END AS content
 FROM (SELECT *, {_TRACE_MW} AS mw FROM mol), (VALUES (0, 'system'), (1, 'user'), (2, 'assistant'), (3, 'user'), (4, 'assistant')) v(i, role)""")
def trace_first_format(spark, d):
    rows = scripted.labelled(scripted.chain_molecules(read(spark, d, "part")).withColumn("prop", F.lit("mw")), "smiles", "prop", "value")
    messages = T.v1_trace(F.lit("?"), F.col("smiles"), F.col("prop"), F.col("value"))
    return _long(rows, "key", messages).drop("tool")


@query(f"""WITH q AS (SELECT DISTINCT row_id, kind, question, smiles, prop, name FROM qa_v3 WHERE kind IN ('single', 'chain'))
 SELECT q.row_id, q.kind, {S.lit(C.SYSTEM_PROMPT)} AS system, q.question AS asked, CASE q.kind WHEN 'chain' THEN d.smiles ELSE q.smiles END AS smiles, q.prop,
 CASE q.kind WHEN 'chain' THEN q.name ELSE '' END AS name
 FROM q LEFT JOIN name_dict d ON d.name = lower(regexp_replace(q.name, '^[\\s\\p{{Z}}\\x{{1C}}-\\x{{1F}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{1C}}-\\x{{1F}}\\x{{85}}]+$', '', 'g')) WHERE q.kind = 'single' OR d.smiles IS NOT NULL""")
def grpo_prompts(spark, d):
    rows = read(spark, d, "qa_v3").where(F.col("kind").isin("single", "chain")).dropDuplicates(["row_id"])
    rows = J.resolve(rows, read(spark, d, "name_dict"))
    chain = F.col("kind") == "chain"
    kept = rows.where(~chain | F.col("resolved").isNotNull())
    prompts = T.grpo_prompts(kept.withColumn("question", F.concat_ws("\u001f", F.col("row_id").cast("string"), "question")))
    asked = F.split(F.col("prompt")[1]["content"], "\u001f")
    return prompts.select(asked[0].cast("bigint").alias("row_id"), "kind", F.col("prompt")[0]["content"].alias("system"), asked[1].alias("asked"), "smiles", "prop", "name")


@query(f"""WITH r AS (SELECT p_partkey AS key, p_size, CASE WHEN p_partkey % 2 = 0 THEN 'chain' ELSE 'single' END AS kind, p_partkey % 5 AS act FROM part),
 s AS (SELECT key, kind, act, p_size, CASE act WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 3 ELSE 1 END AS nc, act = 1 OR act = 3 AS looked, act NOT IN (2) AS computed FROM r)
 SELECT key, kind, round(CASE WHEN act = 4 THEN 0.0 ELSE CASE WHEN act IN (0, 1, 3) THEN 1.0 ELSE 0.0 END
  - CASE WHEN kind = 'chain' AND NOT looked THEN 0.3 ELSE 0.0 END - CASE WHEN NOT computed THEN 0.3 ELSE 0.0 END
  - 0.1 * greatest(0, nc - CASE kind WHEN 'chain' THEN 2 ELSE 1 END) END, 6)::DOUBLE AS reward FROM s""")
def grpo_reward(spark, d):
    act = F.col("p_partkey") % 5
    kind = F.when(F.col("p_partkey") % 2 == 0, "chain").otherwise("single")
    size = F.col("p_size").cast("string")
    compute = T.call_message(C.COMPUTE_TOOL, smiles=F.lit("C"), property=F.lit("hbd"))
    look = T.call_message(C.NAME_TOOL, name=F.lit("x"))
    good = T.message("assistant", F.concat(F.lit("answer: "), size))
    messages = (
        F.when(act == 0, F.array(compute, good)).when(act == 1, F.array(look, compute, good))
        .when(act == 2, F.array(T.message("assistant", "who knows"))).when(act == 3, F.array(look, compute, compute, good))
        .otherwise(F.array(compute))
    )
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("key"), kind.alias("kind"), messages.alias("messages"), size.alias("truth"))
    value = T.reward(F.col("messages"), F.col("kind"), F.lit("int"), F.lit(None).cast("double"), F.col("truth"))
    return rows.select("key", "kind", F.round(value, 6).alias("reward"))


# --- whole evaluation ---------------------------------------------------------------------------------------------------


def _question_rows(spark, d):
    """All records of the six kinds, each once, with kinds and props as their terms; a multi record needs its pairs."""
    snake = lambda c: F.replace(term(c), F.lit(" "), F.lit("_"))
    rows = read(spark, d, "qa_v3").where("row_id is not null").dropDuplicates(["row_id"])
    pairs = F.transform("pairs", lambda p: F.struct(p["smiles"].alias("smiles"), snake(p["prop"]).alias("prop")))
    rows = rows.select(
        F.col("row_id").alias("episode"), snake("kind").alias("kind"), "question", "smiles", snake("prop").alias("prop"), pairs.alias("pairs"), "name", "answer", "clarify_text"
    )
    listed = F.col("prop").isin(*C.ALL_PROPERTIES)
    known = (
        F.when(F.col("kind").isin("single", "error"), listed & F.col("smiles").isNotNull()).when(F.col("kind") == "chain", listed & F.col("name").isNotNull())
        .when(F.col("kind") == "multi", F.forall("pairs", lambda p: p["smiles"].isNotNull() & p["prop"].isin(*C.ALL_PROPERTIES)))
        .when(F.col("kind") == "no_tool", F.col("answer").isNotNull()).when(F.col("kind") == "clarify", F.col("clarify_text").isNotNull())
    )
    return rows.where(known)


@query()
def evaluate_gold(spark, d):
    """Scores of the gold transcripts of all records that name what they ask for, by the whole evaluation."""
    rows = cut(_question_rows(spark, d))
    dictionary = read(spark, d, "name_dict")
    results = evaluate.evaluate(rows, evaluate.gold_turns(rows, dictionary), dictionary)
    return results.select("episode", "kind", "correct", "tool_valid")
