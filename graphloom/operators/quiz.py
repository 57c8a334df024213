"""Question planning as set operations over all concepts: plans, levels, answers, distractors, items, reviews, jobs.

Where the order of relations decides, names are taken in their order. Edges run from prerequisite to dependent and from
part to whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.keys import clean_field, plain_key, plural_key
from graphloom.operators import graphq
from graphloom.session import cut

KEY = ["concept", "plan"]


def plans(features: DataFrame) -> DataFrame:
    """(concept, plan, prio): kinds of question that a concept's relations allow, in order; definition if there is none."""
    kinds = F.array_compact(
        F.array(
            F.when(F.col("has_confusable") == 1, F.lit("1 concept_discrimination")),
            F.when(F.col("n_prereqs") + F.col("n_dependents") > 0, F.lit("2 prerequisite_dependency")),
            F.when(F.col("n_parts") > 0, F.lit("3 component_membership")).when(F.col("n_wholes") > 0, F.lit("3 whole_decomposition")),
            F.when(F.col("has_two_hop") == 1, F.lit("4 multi_hop_reasoning")),
        )
    )
    some = F.when(F.size(kinds) == 0, F.array(F.lit("5 definition"))).otherwise(kinds)
    return features.select("concept", F.explode(some).alias("k")).select("concept", F.substring_index("k", " ", -1).alias("plan"), F.substring("k", 1, 1).cast("int").alias("prio"))


def plan_edges(features: DataFrame, edges: DataFrame, confused: DataFrame) -> DataFrame:
    """(concept, plan, src, dst, rank): edges that a plan activates: six confusables, four prerequisites (else what
    depends on the concept), four parts (else wholes)."""
    of = lambda kind, side, other: edges.filter(F.col("type") == kind).select(F.col(side).alias("concept"), F.col(other).alias("other"), "src", "dst")
    conf = confused.select(F.col("src").alias("concept"), F.lit("concept_discrimination").alias("plan"), "src", "dst", "rank").filter("rank <= 6")
    out = conf
    for plan, kind, near, far in (("prerequisite_dependency", "prerequisite", "n_prereqs", "n_dependents"), ("component_membership", "part-of", "n_parts", None), ("whole_decomposition", "part-of", None, "n_wholes")):
        first = of(kind, "dst", "src").join(features.filter(F.col(near) > 0).select("concept"), "concept", "left_semi") if near else None
        bare = {"n_dependents": "n_prereqs", "n_wholes": "n_parts"}.get(far)
        second = of(kind, "src", "dst").join(features.filter(F.col(bare) == 0).select("concept"), "concept", "left_semi") if far else None
        rows = first if second is None else second if first is None else first.unionByName(second)
        ranked = rows.join(features.select("concept"), "concept", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("concept").orderBy("other"))).filter("rank <= 4")
        out = out.unionByName(ranked.select("concept", F.lit(plan).alias("plan"), "src", "dst", "rank"))
    return out.join(features.select("concept"), "concept", "left_semi")


def levels(planned: DataFrame, features: DataFrame) -> DataFrame:
    """(concept, plan, bloom, difficulty) of (concept, plan) by the structure around the concept."""
    f = F.col
    bloom = (
        F.when(f("plan").isin("concept_discrimination", "multi_hop_reasoning"), "analysis")
        .when(f("plan") == "prerequisite_dependency", F.when(f("has_two_hop") == 1, "application").otherwise("understanding"))
        .when(f("plan").isin("component_membership", "whole_decomposition"), F.when(f("n_parts") > 1, "analysis").otherwise("understanding"))
        .otherwise("understanding")
    )
    rich = (f("has_two_hop") == 1) | (f("n_prereqs") >= 3) | (f("n_parts") >= 4)
    some = (f("has_confusable") == 1) | (f("n_prereqs") > 0) | (f("n_parts") > 0)
    return planned.join(features, "concept").select("concept", "plan", bloom.alias("bloom"), F.when(rich, "hard").when(some, "medium").otherwise("easy").alias("difficulty"))


def answers(planned: DataFrame, edges: DataFrame) -> DataFrame:
    """(concept, plan, correct, basis): first prerequisite or part where the plan asks for one, else the concept itself."""
    first = lambda kind, name: edges.filter(F.col("type") == kind).groupBy(F.col("dst").alias("concept")).agg(F.min("src").alias(name))
    j = planned.select(*KEY).join(first("prerequisite", "p"), "concept", "left").join(first("part-of", "q"), "concept", "left")
    pre, part = (F.col("plan") == "prerequisite_dependency") & F.col("p").isNotNull(), F.col("plan").isin("component_membership", "whole_decomposition") & F.col("q").isNotNull()
    return j.select(
        *KEY, F.when(pre, F.col("p")).when(part, F.col("q")).otherwise(F.col("concept")).alias("correct"),
        F.when(pre, F.format_string("Prerequisite edge %s -> %s means %s must be learned before %s.", "p", "concept", "p", "concept"))
        .when(part, F.format_string("Part-of edge %s -> %s means %s is a component of %s.", "q", "concept", "q", "concept")).otherwise(F.format_string("Definition of %s.", "concept")).alias("basis"),
    )


def forbidden(answered: DataFrame, edges: DataFrame) -> DataFrame:
    """(concept, plan, option): what can't be a wrong option: the concept, and all its prerequisites or parts if one is the answer."""
    asked = answered.filter("correct <> concept").withColumn("type", F.when(F.col("plan") == "prerequisite_dependency", "prerequisite").otherwise("part-of"))
    more = asked.join(edges.select(F.col("dst").alias("concept"), "type", F.col("src").alias("option")), ["concept", "type"]).select(*KEY, "option")
    return answered.select(*KEY, F.col("concept").alias("option")).unionByName(more)


def candidate_pool(names: DataFrame, edges: DataFrame, concepts: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, option, source, prio, rank) for the given names: 12 confusables, 8 siblings, 12 prerequisite neighbours and 12 similar ones, each option once."""
    asked = names.select("name").distinct()
    row = lambda d, name, option, source, prio: d.select(F.col(name).alias("name"), F.col(option).alias("option"), F.lit(source).alias("source"), F.lit(prio).alias("prio"), F.col("rank").cast("int").alias("rank"))
    pre = edges.filter("type = 'prerequisite'")
    near = pre.select(F.col("dst").alias("name"), F.col("src").alias("option"), F.lit(0).alias("side")).unionByName(pre.select(F.col("src").alias("name"), F.col("dst").alias("option"), F.lit(1).alias("side")))
    near = near.join(asked, "name", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("side", "option"))).filter("rank <= 12")
    pool = (
        row(graphq.confusable(concepts, 12), "src", "dst", "similar/confusable", 1)
        .unionByName(row(graphq.sibling_parts(edges.filter("type = 'part-of'"), 8), "concept", "sibling", "sibling-part-of", 2))
        .unionByName(row(near, "name", "option", "prereq-neighbor", 3))
        .unionByName(row(graphq.similar(labels, 12), "src", "dst", "same_topic", 4))
    ).join(asked, "name", "left_semi")
    return pool.groupBy("name", "option").agg(F.min(F.struct("prio", "rank", "source")).alias("p")).select("name", "option", "p.source", "p.prio", "p.rank")


def distractors(answered: DataFrame, banned: DataFrame, pool: DataFrame, universe: DataFrame, k: int = 3) -> DataFrame:
    """(concept, plan, option, source, rank): k wrong options: from the pool of the answer, of the concept, then any name in order.

    universe: (option) names. The last tier needs no more names than an item's banned and chosen ones and k.
    """
    side = lambda c, tier: answered.select(*KEY, F.col(c).alias("name")).join(pool, "name").select(*KEY, "option", "source", F.lit(tier).alias("tier"), "prio", "rank")
    met = side("correct", 1).unionByName(side("concept", 2)).join(banned, [*KEY, "option"], "left_anti")
    once = met.groupBy(*KEY, "option").agg(F.min(F.struct("tier", "prio", "rank", "source")).alias("p"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy("p.tier", "p.prio", "p.rank", "option"))).filter(F.col("r") <= k).select(*KEY, "option", F.col("p.source").alias("source"), "r")
    n = answered.select(*KEY).join(ranked.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), KEY, "left").join(banned.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_banned")), KEY, "left")
    short = n.filter(F.coalesce("n", F.lit(0)) < k).select(*KEY, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n_banned", F.lit(0)) + 2 * k).cast("int").alias("most"))
    most = short.agg(F.max("most")).first()[0] or 0
    firsts = universe.select("option").distinct().orderBy("option").limit(most).withColumn("place", F.row_number().over(Window.orderBy("option")))  # `most` rows
    more = short.select(*KEY, "n", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("place")).join(firsts, "place").join(banned, [*KEY, "option"], "left_anti").join(ranked.select(*KEY, "option"), [*KEY, "option"], "left_anti")
    tail = more.withColumn("r", F.col("n") + F.row_number().over(Window.partitionBy(*KEY).orderBy("option"))).filter(F.col("r") <= k).select(*KEY, "option", F.lit("same_topic").alias("source"), "r")
    return ranked.unionByName(tail).withColumn("rank", F.col("r").cast("int")).drop("r")


def stem_text(plan: Column, concept: Column) -> Column:
    """Question text of a plan."""
    ask = lambda text: F.format_string(text, concept)
    return (
        F.when(plan == "prerequisite_dependency", ask('According to the prerequisite relations in the knowledge graph, which concept should typically be mastered before learning "%s"?'))
        .when(plan.isin("component_membership", "whole_decomposition"), ask('According to the part-of relations in the knowledge graph, which concept is a component of "%s"?'))
        .when(plan == "concept_discrimination", ask('Based on the concept definition and confusable relations, which option best matches the meaning or boundary of "%s"?'))
        .otherwise(ask('Based on the concept definition, which option best matches the meaning of "%s"?'))
    )


def items(answered: DataFrame, wrong: DataFrame, seed: str = "42") -> DataFrame:
    """(concept, plan, stem, options, answer, explanation): items with options A to D in an order fixed by a digest."""
    options = answered.select(*KEY, F.col("correct").alias("option"), F.lit(0).alias("rank")).unionByName(wrong.select(*KEY, "option", "rank"))
    h = F.sha2(F.concat_ws("|", F.lit(seed), "concept", "plan", "option"), 256)
    placed = options.withColumn("label", F.substring(F.lit("ABCDEFGH"), F.row_number().over(Window.partitionBy(*KEY).orderBy(h, "option")), F.lit(1)))
    one = placed.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "option")))).alias("options"), F.max(F.when(F.col("rank") == 0, F.col("label"))).alias("answer"), F.array_sort(F.collect_list(F.when(F.col("rank") > 0, F.struct("rank", "option")))).alias("w"))
    why = F.transform("w", lambda x: F.concat(x["option"], F.lit(" is incorrect because it differs from "), F.col("correct"), F.lit(" in its role or definition.")))
    return one.join(answered.select(*KEY, "correct"), KEY).select(
        *KEY, stem_text(F.col("plan"), F.col("concept")).alias("stem"), "options", "answer", "correct",
        F.concat_ws(" ", F.concat(F.lit("The correct concept is "), F.col("correct"), F.lit(", supported by the graph and definition.")), F.array_join(why, " ")).alias("explanation"),
    )


def item_checks(made: DataFrame, bloom: DataFrame, wrong: DataFrame) -> DataFrame:
    """(concept, plan, nine checks, passed, route, reason): checks of items and where a failed one goes."""
    o = F.map_values("options")
    schema = F.col("stem").isNotNull() & (F.array_join(F.array_sort(F.map_keys("options")), "") == "ABCD") & F.array_contains(F.map_keys("options"), F.col("answer"))
    unique = F.size(F.array_distinct(o)) == 4
    matches = F.coalesce(F.contains(F.element_at("options", F.col("answer")), F.col("correct")), F.lit(False))
    n = wrong.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_wrong"))
    j = made.join(bloom.select(*KEY, "bloom"), KEY, "left").join(n, KEY, "left").select(
        *KEY, (schema & unique & matches).alias("unique_answer"), schema.alias("answerable"), (F.contains("stem", "concept") | (F.col("plan") == "prerequisite_dependency")).alias("on_topic"),
        (schema & F.rtrim("stem").rlike("[？?]$")).alias("clear_language"), unique.alias("options_exclusive"), (unique & (F.coalesce("n_wrong", F.lit(0)) == 3)).alias("distractors_valid"),
        F.col("bloom").isNotNull().alias("bloom_aligned"), matches.alias("graph_faithful"), F.contains("explanation", "correct").alias("explanation_supported"),
    )
    return routed(j)


CHECKS = ["unique_answer", "answerable", "on_topic", "clear_language", "options_exclusive", "distractors_valid", "bloom_aligned", "graph_faithful", "explanation_supported"]
#: Other names under which a check may be given.
CHECK_NAMES = {
    "unique_answer": ["answer_correctness", "single_correct_answer", "correct_answer_unique"],
    "answerable": ["concept_definition_consistency", "concept_consistency", "answerability", "sufficient_information", "format_compliance"],
    "on_topic": ["blueprint_alignment", "topic_relevance", "target_alignment"],
    "clear_language": ["stem_clarity", "language_clarity", "clarity"],
    "options_exclusive": ["option_validity", "option_exclusivity", "option_independence", "option_count"],
    "distractors_valid": ["distractor_plausibility", "distractor_validity", "distractors_plausible"],
    "bloom_aligned": ["bloom_taxonomy_alignment", "bloom_alignment"],
    "graph_faithful": ["knowledge_graph_consistency", "graph_consistency", "kg_consistency"],
    "explanation_supported": ["explanation_quality", "explanation_accuracy", "explanation_consistency", "explanation_validity"],
}


def named_check(given: Column, name: str) -> Column:
    """A check from a map of names to texts, under its own name or the first other one that is given."""
    return F.coalesce(*[given[n] for n in (name, *CHECK_NAMES[name])])


def routed(checks: DataFrame) -> DataFrame:
    """Checks with passed, route and reason: the first failure in order decides who has to work again."""
    ok = lambda *names: F.expr(" and ".join(names))
    cases = [
        (ok("on_topic"), "planner", "on_topic failed"), (ok("unique_answer"), "answer_distractor", "unique_answer failed"), (ok("options_exclusive", "distractors_valid"), "answer_distractor", "distractors/options failed"),
        (ok("answerable", "clear_language", "explanation_supported"), "writer", "language or explanation failed"), (ok("bloom_aligned"), "writer", "bloom_aligned failed"), (ok("graph_faithful"), "answer_distractor", "graph_faithful failed"),
    ]
    pick = lambda k: F.coalesce(*[F.when(~c[0], F.lit(c[k])) for c in cases])
    return checks.withColumns({"passed": ok(*CHECKS), "route": pick(1), "reason": pick(2)})


# ---------------------------------------------------------------- reviews


def expected_type(stem: Column) -> Column:
    """Kind of answer that a stem asks for, by the first pattern that it meets."""
    s = F.lower(stem)
    return (
        F.when(s.rlike("procedure|method|technique|approach|algorithm"), "method").when(s.rlike("metric|measure|score|ratio|rate"), "metric")
        .when(s.rlike("test set|validation set|dataset"), "dataset").when(s.rlike("error|loss"), "error")
    )


def scope_expected_type(stem: Column) -> Column:
    s = F.lower(stem)
    return (
        F.when(s.rlike("method|technique|approach|algorithm"), "method").when(s.rlike("metric|measure|score|ratio|rate"), "metric")
        .when(s.rlike("dataset|training set|validation set|test set"), "dataset").when(s.rlike("error|loss|cost"), "error")
    )


def _type(name: Column, method: str) -> Column:
    n = F.lower(name)
    return (
        F.when(n.rlike("error|loss|cost"), "error").when(n.rlike("set|dataset|fold"), "dataset").when(n.rlike("matrix"), "matrix")
        .when(n.rlike("accuracy|precision|recall|f1|score|auc|rate|ratio|metric"), "metric").when(n.rlike(method), "method")
    )


def concept_type(name: Column) -> Column:
    """Kind of concept by the first pattern that its name meets."""
    return _type(name, "validation|cross validation|bootstrap|hold[- ]?out|algorithm|method|approach|technique|regression|clustering|model")


def scope_concept_type(name: Column) -> Column:
    return _type(name, "algorithm|method|approach|technique|regression|clustering|model")


def weak_option(expected: Column, actual: Column) -> Column:
    """Whether an option can be crossed out by its kind alone."""
    return F.coalesce((expected == "method") & actual.isin("error", "dataset", "matrix", "metric"), F.lit(False)) | F.coalesce((expected == "metric") & actual.isin("dataset", "matrix", "method"), F.lit(False)) | F.coalesce(expected != actual, F.lit(False))


def distractor_review(made: DataFrame) -> DataFrame:
    """(concept, plan, expected, n_weak, weak, passed, constraint): wrong options that their kind gives away."""
    each = made.select(*KEY, expected_type(F.col("stem")).alias("expected"), "answer", F.explode("options").alias("label", "option")).filter("label <> answer")
    w = weak_option(F.col("expected"), concept_type(F.col("option")))
    out = each.groupBy(*KEY, "expected").agg(F.count_if(w).alias("n_weak"), F.array_join(F.array_sort(F.collect_list(F.when(w, F.concat_ws("=", "label", "option")))), "; ").alias("weak"))
    constraint = F.when(F.col("expected") == "method", "methods").when(F.col("expected") == "metric", "metrics").otherwise("same type")
    return out.select(*KEY, "expected", "n_weak", "weak", (F.col("n_weak") == 0).alias("passed"), constraint.alias("constraint"))


def meets_constraint(name: Column, wants: str) -> Column:
    """Whether a name can replace a weak option where methods or metrics are wanted."""
    n = F.lower(name)
    if wants == "method":
        return ~n.rlike("error|loss|cost|set|matrix|accuracy|precision|recall|score") & n.rlike("validation|bootstrap|hold|method|algorithm|regression|clustering|learning|approach")
    if wants == "metric":
        return ~n.rlike("set|matrix|dataset|method|algorithm") & n.rlike("accuracy|precision|recall|f1|score|rate|ratio|error")
    return F.lit(True)


#: Names that fill up the options where the graph has too few of the kind.
SYNTHETIC_METHODS = ("hold-out validation", "bootstrap validation", "leave-one-out validation")
SYNTHETIC = ("related alternative to %s", "neighboring concept of %s", "contrasting concept to %s")


def revised(answered: DataFrame, made: DataFrame, review: DataFrame, pool: DataFrame, k: int = 3) -> DataFrame:
    """(concept, plan, option, source, rank): new wrong options of the items that the review refused.

    Weak options, the concept and the answer are out. Candidates come from the pools of the answer and of the concept;
    for questions after a method or metric only names of methods do (what is to be avoided names them too). Then
    synthetic names fill up.
    """
    failed = review.filter(~F.col("passed")).select(*KEY, "expected")
    each = made.join(failed, KEY).select(*KEY, "expected", "answer", F.explode("options").alias("label", "option")).filter("label <> answer")
    weak = each.filter(weak_option(F.col("expected"), concept_type(F.col("option")))).select(*KEY, "option")
    items_ = answered.join(failed, KEY)
    out = weak.unionByName(items_.select(*KEY, F.explode(F.array("concept", "correct")).alias("option")))
    methods = F.col("expected").isin("method", "metric")
    side = lambda c, tier: items_.withColumn("name", F.col(c)).join(pool, "name").select(*KEY, "expected", "option", "source", F.lit(tier).alias("tier"), "prio", "rank")
    met = side("correct", 1).unionByName(side("concept", 2)).join(out, [*KEY, "option"], "left_anti").filter(~F.coalesce(methods, F.lit(False)) | meets_constraint(F.col("option"), "method"))
    made_up = lambda i: F.when(methods, F.lit(SYNTHETIC_METHODS[i])).otherwise(F.format_string(SYNTHETIC[i], "correct"))
    fill = items_.select(*KEY, "expected", F.posexplode(F.array(*map(made_up, range(3)))).alias("rank", "option")).select(*KEY, "expected", "option", F.lit("synthetic").alias("source"), F.lit(3).alias("tier"), F.lit(0).alias("prio"), "rank")
    once = met.unionByName(fill).groupBy(*KEY, "option").agg(F.min(F.struct("tier", "prio", "rank", "source")).alias("p"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("p.tier", "p.prio", "p.rank", "option"))).filter(F.col("rank") <= k).select(*KEY, "option", F.col("p.source").alias("source"), "rank")


#: Fixed value: bits that tell most runs of words that are no term; more terms only let more runs through.
RUN_BITS = 1 << 22


def mentions(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, id) of the texts (id, text) that have a term as whole words.

    Digests of a text's runs of as many words as terms have meet those of the terms by equality; the bounded phrase is
    then looked for. Runs whose bit no term sets are left out before they are moved.
    """
    spark = terms.sparkSession
    t = cut(terms.select("term", plain_key(F.col("term")).alias("k")).filter("k <> ''").distinct().select("term", F.size(F.split("k", " ")).alias("w"), F.xxhash64("k").alias("h")))
    sizes = sorted(r[0] for r in t.select("w").distinct().collect())  # word counts of names
    if not sizes:
        return terms.select("term").join(texts.select("id"), F.lit(False))
    words = texts.select("id", clean_field(F.col("text")).alias("text"), F.split(plain_key(F.col("text")), " ").alias("ws"))
    def runs_of(w: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - w + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("ws", i, F.lit(w)), " ")))

    bit = F.pmod(F.col("h"), F.lit(RUN_BITS))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    place = F.floor(bit / 64)
    bits = spark.range(RUN_BITS // 64).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("m")).unionByName(t.select(place.alias("i"), mask.alias("m"))).groupBy("i").agg(F.bit_or("m").alias("m"))
    known = bits.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda b: b["m"]).alias("bits"))  # one row
    runs = words.select("id", F.explode(F.array_distinct(F.flatten(F.array(*map(runs_of, sizes))))).alias("h"))
    kept = runs.join(F.broadcast(known), F.get("bits", place.cast("int")).bitwiseAND(mask) != 0).select("id", "h")
    met = kept.join(t.select("h", "term"), "h").select("id", "term").distinct().join(words.select("id", "text"), "id")
    whole = F.concat(F.lit(r"(?<![a-z0-9])\Q"), clean_field(F.col("term")), F.lit(r"\E(?![a-z0-9])"))
    return met.filter(F.rlike("text", whole)).select("term", "id")


def course_evidence(terms: DataFrame, aliases: DataFrame, profiles: DataFrame, contexts: DataFrame) -> DataFrame:
    """(term, kind, n): evidence that a term is part of a course.

    A term that is a name or alias (alias_key, concept) has its concept, profile (concept, profile) and contexts
    (id, concept, evidence); any other has the profiles and contexts that mention it, a context that came twice once.
    """
    t = cut(terms.select("term").distinct().withColumn("alias_key", clean_field(F.col("term"))).join(aliases.select("alias_key", "concept"), "alias_key", "left").drop("alias_key"))
    known, other = t.filter("concept is not null"), t.filter("concept is null").select("term")
    own = known.select("term", F.lit("concept").alias("kind")).unionByName(known.join(profiles, "concept").select("term", F.lit("profile").alias("kind"))).unionByName(known.join(contexts, "concept").select("term", F.lit("metadata").alias("kind")))
    # both kinds of text are searched at once; the first letter of their ids tells them apart
    text = lambda d, kind, i, x: d.select(F.concat(F.lit(kind), F.col(i)).alias("id"), F.col(x).alias("text"))
    texts = text(profiles, "p", "concept", "profile").unionByName(text(contexts.filter("concept is not null").select("id", "evidence").distinct(), "c", "id", "evidence"))
    said = mentions(other, texts).select("term", F.when(F.col("id").startswith("p"), "profile_mention").otherwise("metadata_mention").alias("kind"))
    return own.unionByName(said).groupBy("term", "kind").agg(F.count(F.lit(1)).alias("n"))


#: Scores of the relations between a concept and a possible replacement.
SCOPE_SCORES = {"confusable": 100, "sibling-part-of": 85, "prerequisite": 75, "part-of": 75, "similarity": 65}


def scope_candidates(answered: DataFrame, wrong: DataFrame, edges: DataFrame, concepts: DataFrame, labels: DataFrame, evidenced: DataFrame, most: int = 40) -> DataFrame:
    """(concept, plan, option, score, relation, rank): the `most` best related names of an item, of which those with evidence stay.

    Relations of the concept and of the answer count; of several the highest score does, the first named on ties.
    """
    asked = answered.select(F.col("concept").alias("name")).union(answered.select("correct")).distinct()
    row = lambda d, a, b, relation, order: d.select(F.col(a).alias("name"), F.col(b).alias("option"), F.lit(SCOPE_SCORES[relation]).alias("score"), F.lit(relation).alias("relation"), F.lit(order).alias("o"))
    pre, part = edges.filter("type = 'prerequisite'"), edges.filter("type = 'part-of'")
    # of one whole, nobody needs more parts, in the order of names, than the most that are ranked and those left out
    heads = part.withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).filter(F.col("r") <= most + 8).select("dst", F.col("src").alias("option"))
    siblings = part.join(asked.withColumnRenamed("name", "src"), "src", "left_semi").join(heads, "dst").filter("src <> option")
    rel = (
        row(graphq.confusable(concepts, most + 8), "src", "dst", "confusable", 1).unionByName(row(siblings, "src", "option", "sibling-part-of", 2))
        .unionByName(row(pre, "dst", "src", "prerequisite", 3)).unionByName(row(pre, "src", "dst", "prerequisite", 4)).unionByName(row(part, "dst", "src", "part-of", 5)).unionByName(row(part, "src", "dst", "part-of", 6))
        .unionByName(row(graphq.similar(labels, None), "src", "dst", "similarity", 7))
    ).join(asked, "name", "left_semi")
    sides = answered.select(*KEY, F.explode(F.array_distinct(F.array("concept", "correct"))).alias("name"))
    out = answered.select(*KEY, F.explode(F.array("concept", "correct")).alias("option")).unionByName(wrong.select(*KEY, "option"))
    best = sides.join(rel, "name").select(*KEY, "option", "score", "relation", "o").join(out, [*KEY, "option"], "left_anti").groupBy(*KEY, "option").agg(F.max(F.struct("score", (-F.col("o")).alias("o"), "relation")).alias("b"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("b.score"), "option"))).filter(F.col("rank") <= most)
    return ranked.join(evidenced.select(F.col("term").alias("option")).distinct(), "option", "left_semi").select(*KEY, "option", F.col("b.score").alias("score"), F.col("b.relation").alias("relation"), "rank")


def scope_replacements(made: DataFrame, candidates: DataFrame, evidenced: DataFrame) -> DataFrame:
    """(concept, plan, label, option, replacement): wrong options without evidence, each with the first suitable candidate not yet used.

    The n-th such option of an item takes the n-th suitable candidate; null where there is none.
    """
    each = made.select(*KEY, "stem", "answer", F.explode("options").alias("label", "option")).filter("label <> answer")
    lost = each.join(evidenced.select(F.col("term").alias("option")).distinct(), "option", "left_anti").withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("label")))
    e, a = scope_expected_type(F.col("stem")), scope_concept_type(F.col("option"))
    fits = ~F.coalesce(e != a, F.lit(False)) & (F.col("score") >= 65)
    good = candidates.join(made.select(*KEY, "stem"), KEY).filter(fits).withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("rank"))).select(*KEY, "place", F.col("option").alias("replacement"))
    return lost.join(good, [*KEY, "place"], "left").select(*KEY, "label", "option", "replacement")


def published(made: DataFrame, wrong: DataFrame) -> DataFrame:
    """(concept, plan, label, option, source): what is known of each wrong option, bound to its label in the final item."""
    return made.select(*KEY, F.explode("options").alias("label", "option")).join(wrong.select(*KEY, "option", "source"), [*KEY, "option"]).select(*KEY, F.concat(F.lit("option_"), F.col("label")).alias("label"), "option", "source")


def calculations(concepts: DataFrame, formulas: DataFrame) -> DataFrame:
    """(concept, n_formulas, formula_id, latex): a calculation plan for each concept with formulas (concept, formula_id, latex), on the first of them."""
    one = formulas.groupBy("concept").agg(F.count(F.lit(1)).alias("n_formulas"), F.min(F.struct("formula_id", "latex")).alias("f"))
    return concepts.select(F.col("canonical").alias("concept")).join(one, "concept").select("concept", "n_formulas", "f.formula_id", "f.latex")


# ---------------------------------------------------------------- jobs


def jobs(concepts: DataFrame, contexts: DataFrame, done: DataFrame) -> DataFrame:
    """(concept_id, canonical, chapter, status): one job per concept with its first chapter; done, ready or no_chapter."""
    first = contexts.groupBy(F.lower("concept").alias("canonical")).agg(F.min("chapter").alias("chapter"))
    finished = done.select(F.lower("concept").alias("canonical"), F.lit(1).alias("ok")).distinct()
    return concepts.select("concept_id", "canonical").join(first, "canonical", "left").join(finished, "canonical", "left").select(
        "concept_id", "canonical", "chapter", F.when(F.col("ok") == 1, "done").when(F.col("chapter").isNull(), "no_chapter").otherwise("ready").alias("status")
    )


def job_summary(planned: DataFrame) -> DataFrame:
    """(total, generated, skipped, failed) of the jobs."""
    return planned.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ready").alias("generated"), F.count_if(F.col("status") == "done").alias("skipped"), F.count_if(F.col("status") == "no_chapter").alias("failed"))


def valid_name(name: Column) -> Column:
    """Whether a text can be the name of a concept: length, a letter, words, no numbered heading."""
    words = F.size(F.split(F.trim(name), "[ \t]+"))
    return (F.length(name) > 0) & (F.length(name) <= 100) & name.rlike("[a-z]") & (words <= 10) & ~name.rlike(r"^(?:chapter|section|example|exercise)[ \t]+[0-9]+(?:\.[0-9]+)*$")


#: Phrases that no name of a concept holds; a course adds its own.
BLOCKED = ("youtube", "github", "special thanks", "recall box", "papers with code", "dgl", "dgl lecture")


def unblocked(name: Column, blocked: tuple[str, ...] = BLOCKED) -> Column:
    """Whether a name holds none of the blocked phrases, both without plurals."""
    return ~F.exists(F.array(*[plural_key(F.lit(b)) for b in blocked]), lambda b: F.contains(plural_key(name), b))
