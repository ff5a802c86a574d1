"""Inline relations: properties, question templates, banks, tool names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Properties with type and tolerance.
PROPERTIES = (
    ("mw", "float", 0.1), ("logp", "float", 0.1), ("tpsa", "float", 0.1), ("hbd", "int", None), ("hba", "int", None),
    ("ring_count", "int", None), ("lipinski", "bool", None), ("validity", "bool", None), ("canonical", "str", None),
    ("qed", "float", 0.02), ("formula", "str_exact", None), ("num_stereocenters", "int", None), ("veber", "bool", None),
    ("pains_alert", "bool", None),
)
V1_PROPERTIES = tuple(p for p, _, _ in PROPERTIES[:9])
ALL_PROPERTIES = tuple(p for p, _, _ in PROPERTIES)
# Property pairs of two-part questions; the benchmark uses the first five.
PROPERTY_PAIRS = (
    ("mw", "logp"), ("hbd", "hba"), ("ring_count", "validity"), ("mw", "tpsa"), ("lipinski", "logp"), ("tpsa", "hba"),
)
# Names in the tool-calling format.
COMPUTE_TOOL = "rdkit_compute"
NAME_TOOL = "name_to_smiles"
MAX_TURNS = 6
# Arguments each tool needs, with the values one may take, and what it says where it has no result.
TOOLS = {COMPUTE_TOOL: {"smiles": None, "property": ALL_PROPERTIES}, NAME_TOOL: {"name": None}}
TOOL_TEXTS = {COMPUTE_TOOL: "Compute a property of the molecule given as SMILES.", NAME_TOOL: "Find the SMILES of a molecule by its name."}
TOOL_ERRORS = {COMPUTE_TOOL: "invalid molecule", NAME_TOOL: "unknown name"}
# Words that make an answer a question back, or a report of failure.
CLARIFY_WORDS = {2: ("smiles", "which molecule", "provide", "specify", "what molecule")}
CLARIFY_WORDS[3] = (*CLARIFY_WORDS[2], "name")
ERROR_WORDS = {2: ("invalid", "error", "couldn't", "cannot", "can't", "unable")}
ERROR_WORDS[3] = (*ERROR_WORDS[2], "unknown")
# Spellings of truth values.
TRUE_WORDS = ("true", "yes", "1", "pass", "passes")
FALSE_WORDS = ("false", "no", "0", "fail", "fails")
# Characters that a corruption puts into a SMILES.
CORRUPTION = "()[]@123"
# Rates of side rows per molecule, cap of bank and chain repeats.
CORRUPT_RATE_V1, ERROR_RATE, MULTI_RATE, CLARIFY_RATE = 0.25, 0.15, 0.40, 0.15
BANK_REPEAT_CAP, CHAIN_REPEAT_CAP = 5, 100
# Weights of the reward.
MISSING_CALL_PENALTY, EXTRA_CALL_PENALTY = 0.3, 0.1

SYSTEM_PROMPT = (
    "Answer the question. Use a tool only for a molecular property or to find the structure behind a name. "
    "Ask back when the molecule is missing, and say so plainly when a tool fails."
)
ERROR_TEXT = "No value can be given: the SMILES seems to be invalid."
CLARIFY_TEXT = "Please provide the SMILES of the molecule you mean."

TEMPLATES = {
    "mw": ("Give the molar mass of {smiles}.", "What does a mole of {smiles} weigh in grams?"),
    "logp": ("Give the estimated logP of {smiles}.", "On the logP scale, where does {smiles} stand?"),
    "tpsa": ("Give the polar surface of {smiles}.", "Work out the TPSA for {smiles}."),
    "hbd": ("Count the hydrogen bond donors in {smiles}.", "Donor groups of {smiles}: how many?"),
    "hba": ("Count the hydrogen bond acceptors in {smiles}.", "Acceptor groups of {smiles}: how many?"),
    "ring_count": ("Count the rings in {smiles}.", "{smiles}: number of cycles?"),
    "lipinski": ("Is {smiles} within the rule of five (true or false)?", "Rule of five for {smiles}: kept, true or false?"),
    "validity": ("Is {smiles} a well-formed structure (true or false)?", "Does {smiles} parse, true or false?"),
    "canonical": ("Write {smiles} in canonical form.", "Standard notation of {smiles}, please."),
    "qed": ("Give the QED of {smiles}.",),
    "formula": ("Give the sum formula of {smiles}.",),
    "num_stereocenters": ("Count the stereocentres of {smiles}.",),
    "veber": ("Does {smiles} keep both of Veber's limits (true or false)?",),
    "pains_alert": ("Is {smiles} flagged by an interference filter (true or false)?",),
}
NAME_TEMPLATES = {
    p: tuple(t.replace("{smiles}", "{name}") for t in (*TEMPLATES[p], f"For {{name}}, tell me the {p.replace('_', ' ')}.")[:2])
    for p in ALL_PROPERTIES if p != "validity"
}
NAME_TEMPLATES["mw"] = (*NAME_TEMPLATES["mw"], "Could you look up how heavy {name} is?")

# Questions that need no tool, with answers; their place decides their split.
BANK = tuple(
    [(f"How many days are there in {w} weeks?", str(7 * w)) for w in range(1, 16)]
    + [(f"In which group of the periodic table does element number {z} stand?", str(g))
       for z, g in ((3, 1), (4, 2), (5, 13), (6, 14), (7, 15), (8, 16), (9, 17), (10, 18), (11, 1), (12, 2), (13, 13), (14, 14), (15, 15), (16, 16))]
    + [("Are you able to run tools?", "yes"), ("Do you keep my files?", "no"), ("Can you make mistakes?", "yes"),
       ("Do you answer in English?", "yes"), ("Do you need a key to talk to me?", "no"), ("Can you count?", "yes")]
)
CLARIFY_BANK = tuple(
    f"{lead} {what}?"
    for lead, what in (
        ("What is its", "molar mass"), ("What is its", "logP"), ("What is its", "polar surface"), ("How many donors has", "it"),
        ("How many acceptors has", "it"), ("How many rings has", "it"), ("Does it keep", "the rule of five"),
        ("Is this structure", "well formed"), ("What is its", "standard notation"), ("Could you weigh", "this one"),
        ("Is the compound", "greasy"), ("What is the sum formula of", "that sample"), ("Does my compound keep", "Veber's limits"),
    )
)
BENCH_NO_TOOL = (
    ("What is 20 plus 9?", "29"), ("How many hours has a day?", "24"), ("Which metal has the symbol Fe?", "iron"),
    ("What colour has a ripe lemon?", "yellow"), ("How many legs has an insect?", "6"),
)


def tools(version: int) -> dict[str, dict[str, tuple[str, ...] | None]]:
    """The tools that a version of the native format knows: the name tool from version 3 on."""
    return {k: v for k, v in TOOLS.items() if version >= 3 or k != NAME_TOOL}


def metadata(prop: Column, unknown: str = "error") -> Column:
    """``struct<vtype, tol>`` of a property; one that is not in the list is an error, or null with ``unknown="null"``."""
    known = F.create_map(*[x for p, t, tol in PROPERTIES for x in (F.lit(p), F.struct(F.lit(t).alias("vtype"), F.lit(tol).cast("double").alias("tol")))])
    if unknown == "null":
        return F.try_element_at(known, prop)
    message = F.raise_error(F.concat(F.lit("unknown property: "), prop)).cast("struct<vtype:string,tol:double>")
    return F.when(prop.isNull() | prop.isin(*ALL_PROPERTIES), F.try_element_at(known, prop)).otherwise(message)


def property_table(spark: SparkSession) -> DataFrame:
    """``(prop, vtype, tol)``, fourteen rows."""
    return spark.createDataFrame(list(PROPERTIES), "prop string, vtype string, tol double")


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``(prop, n, templates)``: the phrasings of each property in order."""
    return spark.createDataFrame([(p, len(t), list(t)) for p, t in templates.items()], "prop string, n int, templates array<string>")
