"""Review of generated answers against their evidence, over a whole table of them.

``answers``: answer_id, answer, context. Facts about the result come as a table (answer_id, kind, term), for which
:func:`facts_of` derives them from result tables: kinds are unmeasured (a check's name), resistant, uncertain, no_determinant
and unevaluable (drugs), validity (a verdict) and choice (the option that the rules require). What prose calls a check or a
drug comes from phrases by topic and by spelling: each fact gets its phrases once, and meets the sentences of its own answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.functions import drugs as D

# What prose calls a check, by topic; a check has the topics whose name stands in its own.
CHECK_TOPICS = {
    "depth": ("depth", "coverage", "sequenced to", "reads per site"),
    "breadth": ("breadth", "genome covered", "reference covered", "callable fraction", "covered at"),
    "mapped": ("mapped", "mapping rate", "alignment rate", "reads aligned", "on-target"),
    "evenness": ("evenness", "even coverage", "uniformity", "uneven"),
    "gc": ("gc content", "gc"),
    "unambiguous": ("unambiguous", "ambiguous base", "mixed base", "majority rule"),
    "het": ("heterozygos", "hsnp", "het snp", "minor allele", "mixed infection", "mixture", "mixed"),
    "f2": ("f2", "lineage-defining", "lineage defining"),
    "f47": ("f47", "lineage-defining", "lineage defining"),
    "contamination": ("contaminat", "purity", "pure", "second organism", "secondary organism", "foreign read", "off-target read", "other species", "co-infection", "coinfection", "another organism"),
    "kraken": ("kraken", "read classifier", "taxonomic classif", "screen"),
    "target": ("non-target", "non target", "off-target"),
    "barcode": ("barcode", "lineage support", "defining snp", "defining site"),
    "species": ("species", "ani", "identification", "identified"),
    "lineage": ("lineage", "sublineage", "strain family"),
    "minor": ("minor variant", "heteroresistance", "subpopulation", "minority population"),
    "duplicate": ("duplicate", "pcr duplicate"),
    "quality": ("base quality", "read quality", "phred", "q30"),
    "length": ("read length",),
    "callable": ("callable", "target region", "gene coverage", "evaluable"),
    "cluster": ("cluster", "transmission", "snp distance", "linkage"),
    "mask": ("mask", "repetitive region", "pe/ppe"),
    "shared": ("shared callable", "denominator", "sites compared"),
    "catalogue": ("catalogue", "catalog", "who grade", "grading"),
    "validity": ("validity", "valid sample", "usable sample", "fit for"),
}
# Topics of checks whose names do not show them, by a part of the name.
NAME_TOPICS = {
    "purity": ("contamination",), "non target": ("contamination", "target"), "foreign": ("contamination",), "kraken": ("kraken", "contamination"), "screen": ("kraken", "contamination"),
    "f2": ("f2", "het"), "f47": ("f47", "het"), "ani": ("species",), "mixture": ("het",), "hsnp": ("het",), "unambig": ("unambiguous",), "even": ("evenness",),
    "barcode": ("barcode", "lineage"), "distance": ("cluster",),
}
# Spellings of drugs that are also words; a term of at most so many letters must stand as a word.
WORD_SPELLINGS, SHORT_TERM = ("cap", "str", "pa", "sm", "eth", "km"), 4

# Patterns of the wording rules.
NUMBER = r"\d[\d,]*\.?\d*"
SENTENCE = r"[^.!?;\n]+[.!?;\n]?"
SEQUENCE = r"[ACGTNacgtn]{50,}"
ALLOWED_BARE = ("0", "1", "2", "3", "4", "5")
PROSE_FIELDS = ("headline", "body", "reason", "reading", "note", "summary")
SETTLED = (
    r"(?i)\b(no|none|neither|nothing|nil|zero|without|free of|absent|clean|pure|normal|fine|negative|unremarkable|sound|satisfactory|good|excellent|"
    r"not present|not detected|no evidence|no sign|ruled out|excluded)\b"
)
HEDGED = (
    r"(?i)\b(not screened|never screened|not measured|unmeasured|not computed|not calculated|not counted|not assessed|not available|not established|"
    r"not evaluated|not evaluable|no reference|unknown|undetermined|cannot be|could not be|was not run|did not run|not informative|uninformative|unverified|"
    r"not verified|absence of evidence|rather than absent|not the same as|remains? (unknown|unverified)|no measurement|nothing was measured)\b"
)
CONCESSIVE = (
    r"(?i)^\s*(while|although|though|whilst|despite|notwithstanding|even though|aside from|other than|apart from|beyond)\b|"
    r"\b(but|however|nevertheless|nonetheless|yet|except|other than|apart from|beyond that)\b"
)
NEGATED = (
    r"(?i)\b(no|not|never|cannot|can't|without|neither|nor|absence of|lacks?|does not|do not|is not|are not|was not|were not|rather than|must not|should not|may not)\b"
)
SUSCEPTIBLE = (
    r"(?i)\b(susceptible|sensitive)\s+to\b|\b(is|are|was|were|remains?|appears? to be|likely|probably)\s+(fully\s+|still\s+|therefore\s+)?(susceptible|sensitive)\b|"
    r"\b(retains?|retain)\s+(full\s+)?(susceptibility|activity)\b"
)
CLAIM_WORD = r"(?i)susceptib|sensitiv|activity"
RESISTANT_CLAIM = (
    r"(?i)\b(resistant to|resistance to|confers resistance|predicted resistan|is resistant|are resistant|resistance is predicted|"
    r"resistance determinant (was |were )?(detected|found|present))\b"
)
CLEARS_DRUG = (
    r"(?i)\b(remains?|stays?|is still|are still)\s+(active|effective|usable|an option)\b|\bcan (still )?be used\b|\bno resistance\b|"
    r"\bnot resistant\b|\bwithout resistance\b|\bactivity is (retained|preserved)\b"
)
NO_PROBLEMS = r"(?i)\bno\s+(major\s+|significant\s+|apparent\s+)?(issues|problems|concerns|defects|caveats)\b"
GLOBAL_CLAIM = (
    r"(?i)\b(the|this|it)\s+(sample|isolate|result|run|data|sequencing|analysis|report)?\s*\b(is|was|are|were|appears? to be|seems? to be|remains?|looks?)\s+"
    r"(?!not\b|un|in|insufficient|inadequate|unsuitable|unfit|unreliable|unacceptable|invalid|too\b|barely\b|hardly\b|only\b|marginal)"
    r"(a |an |very |fully |entirely )?(fit for (purpose|use|this)|suitable|good enough|acceptable|adequate|usable|reliable|excellent|valid|of high quality|sound|clean|fine|trustworthy)"
)
SUPERLATIVE = r"(?i)\b(the|this)\s+(sample|isolate|result|run|data|sequencing|analysis|report)\s+(is|was)\s+(excellent|fully (valid|suitable)|of high quality|clean|pure)\b"
ORGANISM = r"\b(?:M|Mycobacterium|Mycobacteroides|Mycolicibacterium)\.?\s+([a-z][a-z\-]{3,})\b"
NEGATION_WORDS = 4
RULES = (
    "empty", "unsupported-number", "unmeasured-as-settled", "susceptible-for-no-determinant", "contradicts-drug-call", "contradicts-validity", "invented-organism", "outside-option-set", "overrides-rule",
)


def looks_like_sequence(text: Column) -> Column:
    """Whether a text holds a run of 50 bases or more."""
    return F.coalesce(text.rlike(SEQUENCE), F.lit(False))


def prose(answer: Column) -> Column:
    """The claims of an answer: its prose fields if it is a JSON object, else the text itself."""
    fields = F.array_compact(F.array(*[F.get_json_object(answer, f"$.{f}") for f in PROSE_FIELDS]))
    return F.when(F.trim(answer).rlike(r"(?s)^\{.*\}$") & F.get_json_object(answer, "$").isNotNull(), F.array_join(fields, "\n")).otherwise(F.coalesce(answer, F.lit("")))


def sentences(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), 0), lambda s: F.trim(s))
    return F.filter(found, lambda s: s != "")


def numbers(text: Column) -> Column:
    """The distinct numbers of a text, commas taken out."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), 0)
    return F.array_distinct(F.transform(found, lambda n: F.rtrim(F.replace(n, F.lit(","), F.lit("")), F.lit("."))))


def _decimals(n: Column) -> Column:
    return F.length(F.coalesce(F.get(F.split(n, r"\."), F.lit(1)), F.lit("")))


def unsupported_numbers(answer: Column, context: Column) -> Column:
    """Numbers of the answer that are neither in the context, nor 0 to 5, nor one of the context's written shorter."""
    given = numbers(context)

    def rounded(token: Column) -> Column:
        return F.exists(
            given,
            lambda g: (g.cast("double") == token.cast("double"))
            | ((_decimals(g) > _decimals(token)) & (F.format_string("%.9f", F.bround(g.cast("double") * F.pow(F.lit(10.0), _decimals(token)), 0)) == F.format_string("%.9f", token.cast("double") * F.pow(F.lit(10.0), _decimals(token))))),
        )

    return F.sort_array(F.filter(F.array_except(numbers(answer), given), lambda t: ~t.isin(*ALLOWED_BARE) & ~F.coalesce(rounded(t), F.lit(False))))


def invented_organisms(answer: Column, context: Column) -> Column:
    names = lambda t: F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(ORGANISM), 1), lambda x: F.lower(x))
    return F.sort_array(F.array_except(names(answer), names(context)))


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def check_phrases(name: Column) -> Column:
    """What prose may call a check: the phrases of the topics that its name shows."""
    low = F.lower(F.replace(name, F.lit("_"), F.lit(" ")))
    parts = [F.when(low.contains(topic), _texts(phrases)) for topic, phrases in CHECK_TOPICS.items()]
    parts += [F.when(low.contains(part), _texts(tuple(p for t in topics for p in CHECK_TOPICS[t]))) for part, topics in NAME_TOPICS.items()]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*parts))))


def drug_phrases(drug: Column) -> Column:
    """What prose may call a drug: its name, code and spellings of three letters or more that are no words of their own."""
    known = {d: (code.lower(), *[s for s in D.SPELLINGS.get(d, ()) if len(s) >= 3 and s not in WORD_SPELLINGS]) for d, code in D.CODES.items()}
    spelled = F.create_map(*[x for d, others in known.items() for x in (F.lit(d), _texts(others))])
    name = D.drug_name(drug)
    return F.array_distinct(F.concat(F.array(F.lower(drug), name), F.coalesce(spelled[name], _texts(()))))


def facts_of(checks: DataFrame | None = None, calls: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """(sample_id, kind, term): the facts that result tables hold, for the answers about each sample.

    ``checks``: sample_id, name, measured; ``calls``: sample_id, drug, call, target_covered; ``verdicts``: sample_id,
    verdict. A drug without a call whose target is not covered could not be evaluated; that is not a drug in which nothing
    was found.
    """
    parts = []
    if checks is not None:
        parts.append(checks.filter(~F.coalesce("measured", F.lit(False))).select("sample_id", F.lit("unmeasured").alias("kind"), F.col("name").alias("term")))
    if calls is not None:
        blind = F.coalesce(~F.col("target_covered"), F.lit(False))
        kinds = F.array(
            F.when(F.col("call").isin("R", "R-interim"), "resistant"), F.when(F.col("call") == "Uncertain", "uncertain"), F.when(blind, "unevaluable"), F.when((F.col("call") == "no-call") & ~blind, "no_determinant")
        )
        parts.append(calls.select("sample_id", F.explode(F.array_compact(kinds)).alias("kind"), F.col("drug").alias("term")))
    if verdicts is not None:
        parts.append(verdicts.select("sample_id", F.lit("validity").alias("kind"), F.col("verdict").alias("term")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def _with_phrases(facts: DataFrame) -> DataFrame:
    """``facts`` with ``phrases`` (by the rule of short terms) and ``anywhere`` (parts of any word)."""
    check = F.col("kind") == "unmeasured"
    name = F.lower("term")
    return facts.select(
        "answer_id", "kind", "term", F.when(check, check_phrases(F.col("term"))).otherwise(drug_phrases(F.col("term"))).alias("phrases"),
        F.when(check, F.filter(F.array(name, F.replace(name, F.lit("_"), F.lit(" "))), lambda x: x != "")).otherwise(_texts(())).alias("anywhere"),
    )


def _words(sentence: Column) -> Column:
    return F.regexp_extract_all(F.lower(sentence), F.lit(r"\w+"), 0)


def mentioned(sentence: Column, words: Column, phrases: Column, anywhere: Column) -> Column:
    """Whether a sentence (its ``words`` beside it) has one of the phrases: a short one as a word, a longer one within words too."""
    low = F.lower(sentence)
    return F.exists(anywhere, lambda p: low.contains(p)) | F.exists(phrases, lambda p: F.when(F.length(p) <= SHORT_TERM, F.array_contains(words, p)).otherwise(low.contains(p)))


def negation_governs(sentence: Column) -> Column:
    """Whether a negation stands within four words before the susceptibility word of the sentence's claim.

    The claim is the first match of ``SUSCEPTIBLE``; an earlier word of that kind that claims nothing does not count.
    """
    claim = F.regexp_extract(sentence, SUSCEPTIBLE, 0)
    ahead = F.element_at(F.split(sentence, SUSCEPTIBLE, 2), 1)
    before = F.concat(ahead, F.element_at(F.split(claim, CLAIM_WORD, 2), 1))
    words = F.regexp_extract_all(before, F.lit(r"[\w'-]+"), 0)
    return F.array_join(F.reverse(F.slice(F.reverse(words), 1, NEGATION_WORDS)), " ").rlike(NEGATED)


def sentence_rows(answers: DataFrame) -> DataFrame:
    """(answer_id, i, sentence) of every answer's prose."""
    return answers.select("answer_id", F.posexplode(sentences(prose(F.col("answer")))).alias("i", "sentence"))


def violations(answers: DataFrame, facts: DataFrame | None = None, options: list[str] | None = None) -> DataFrame:
    """(answer_id, rule, at, detail): every rule that an answer breaks, ``at`` the place of the sentence.

    ``facts``: answer_id, kind, term. An answer without a fact of validity is about a sample that was not assessed; one
    without any drug in which nothing was found may not call anything susceptible at all.
    """
    spoken = answers.withColumn("prose", prose(F.col("answer")))
    blank = F.trim(F.coalesce("answer", F.lit(""))) == ""
    zero = F.lit(0).alias("at")
    found = spoken.filter(blank).select("answer_id", F.lit("empty").alias("rule"), zero, F.lit("").alias("detail"))
    filled = spoken.filter(~blank)
    extra = unsupported_numbers(F.col("prose"), F.col("context"))
    found = found.union(filled.select("answer_id", F.lit("unsupported-number"), zero, F.array_join(extra, ", ").alias("d")).filter("d <> ''"))
    names = invented_organisms(F.col("prose"), F.col("context"))
    found = found.union(filled.select("answer_id", F.lit("invented-organism"), zero, F.array_join(names, ", ").alias("d")).filter("d <> ''"))
    if facts is None:
        facts = answers.select("answer_id", F.lit("").alias("kind"), F.lit("").alias("term")).limit(0)
    if options:
        choice = F.trim(F.get_json_object("answer", "$.choice"))
        chosen = filled.select("answer_id", choice.alias("choice"), F.coalesce(choice.isin(*options), F.lit(False)).alias("allowed"))
        found = found.union(chosen.filter("not allowed").select("answer_id", F.lit("outside-option-set"), zero, F.coalesce("choice", F.lit(""))))
        required = facts.filter("kind = 'choice'").groupBy("answer_id").agg(F.min("term").alias("required"))
        found = found.union(chosen.filter("allowed").join(required, "answer_id").filter("choice <> required").select("answer_id", F.lit("overrides-rule"), zero, "choice"))
    s = F.col("sentence")
    has = lambda p: s.rlike(p)
    said = sentence_rows(filled.select("answer_id", "answer")).withColumns({"words": _words(s), "plain": ~has(CONCESSIVE), "hedged": has(HEDGED)})
    # rules about a check or a drug: sentences meet the facts of their own answer
    met = said.join(_with_phrases(facts.filter(F.col("kind").isin("unmeasured", "resistant", "uncertain", "no_determinant", "unevaluable"))), "answer_id")
    met = met.filter(mentioned(s, F.col("words"), F.col("phrases"), F.col("anywhere")))
    settled = (F.col("kind") == "unmeasured") & ~F.col("hedged") & has(SETTLED)
    claim = has(SUSCEPTIBLE) & ~negation_governs(s) & ~F.col("hedged")
    susceptible = F.col("kind").isin("no_determinant", "unevaluable") & claim
    clears = (F.col("kind") == "resistant") & (has(CLEARS_DRUG) | (has(SUSCEPTIBLE) & ~has(NEGATED)))
    asserts = F.col("kind").isin("uncertain", "no_determinant", "unevaluable") & has(RESISTANT_CLAIM) & ~has(NEGATED)
    rules = F.array(F.when(settled, "unmeasured-as-settled"), F.when(susceptible, "susceptible-for-no-determinant"), F.when(F.col("plain") & (clears | asserts), "contradicts-drug-call"))
    found = found.union(met.select("answer_id", F.explode(F.array_compact(rules)), "i", "sentence"))
    # rules about the sample as a whole
    open_ = facts.filter(F.col("kind").isin("no_determinant", "unevaluable")).select("answer_id").distinct()
    found = found.union(said.filter(claim).join(open_, "answer_id", "left_anti").select("answer_id", F.lit("susceptible-for-no-determinant"), "i", "sentence"))
    verdicts = facts.filter("kind = 'validity'").groupBy("answer_id").agg(F.min("term").alias("verdict"))
    whole = said.filter("plain").join(verdicts, "answer_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("not-assessed")))
    sound = F.when(has(NO_PROBLEMS), True).when(F.col("verdict") == "suspect", has(SUPERLATIVE)).when(F.col("verdict") == "not-assessed", has(GLOBAL_CLAIM) & ~F.col("hedged")).otherwise(has(GLOBAL_CLAIM))
    return found.union(whole.filter(F.col("verdict").isin("invalid", "suspect", "not-assessed") & sound).select("answer_id", F.lit("contradicts-validity"), "i", "sentence"))


def review(answers: DataFrame, facts: DataFrame | None = None, options: list[str] | None = None) -> DataFrame:
    """(answer_id, ok, rule, detail): the first rule in order that each answer breaks."""
    broken = violations(answers, facts, options)
    place = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
    first = broken.withColumn("k", F.row_number().over(W.partitionBy("answer_id").orderBy(place, "at", "detail"))).filter("k = 1")
    return answers.select("answer_id").join(first.select("answer_id", "rule", "detail"), "answer_id", "left").withColumn("ok", F.col("rule").isNull())
