"""Answers as text: normalising, scoring, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, and the articles that normalising drops.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
#: Characters and a word that are taken out of predicates.
PREDICATE_NOISE = r"""WHERE|[&*:\]{|}\[()<>#@!$%^+=?/\\`~;,.'"\n\t\r]"""
#: A bundled list, for no corpus of stop words is at hand.
STOP_WORDS = tuple(
    """a about after all also am an and any are as at be because been before being between both but by can could did do
    does doing during each few for from further had has have having he her here hers him his how i if in into is it its
    itself just me more most my no nor not now of off on once only or other our out over own same she should so some such
    than that the their them then there these they this those through to too under until up very was we were what when
    where which while who whom why will with you your""".split()
)
YES_NO = ("yes", "no")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_answer(s: Column | str) -> Column:
    """Lower case; punctuation deleted, not spaced; articles out; white space as one space. Null stays null."""
    bare = F.translate(F.lower(_c(s)), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def tokens(s: Column | str) -> Column:
    """Words of the normalised text; none for null and empty text."""
    return F.filter(F.split(F.coalesce(normalize_answer(s), F.lit("")), " "), lambda t: t != "")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: what a lambda takes from outside is computed anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbered(words: Column) -> Column:
    """Each word with the number of its occurrence, so that sets of these are multisets of words."""
    return _let(F.array_sort(words), lambda s: F.transform(s, lambda w, i: F.concat(w, F.lit(" "), (i - F.array_position(s, w)).cast("string"))))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of words."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def _f1(common: Column, predicted: Column, true: Column) -> Column:
    """Harmonic mean of common/predicted and common/true; 0 without common ones."""
    return F.when(common == 0, 0.0).otherwise(2.0 * common / (predicted + true))


def _both(gold: Column, predicted: Column, body) -> Column:
    """body(gold, predicted, overlap) with each computed once."""
    words = F.struct(gold.alias("g"), predicted.alias("p"))
    return _let(words, lambda x: _let(F.struct(x["g"].alias("g"), x["p"].alias("p"), overlap(x["g"], x["p"]).alias("n")), lambda y: body(y["g"], y["p"], y["n"])))


def answer_f1(gold: Column, predicted: Column) -> Column:
    """Token F1 of two arrays of words; if either is empty, 1 if both are and else 0."""

    def body(g: Column, p: Column, n: Column) -> Column:
        empty = (F.size(g) == 0) | (F.size(p) == 0)
        return F.when(empty, (F.size(g) == F.size(p)).cast("double")).otherwise(_f1(n, F.size(p), F.size(g)))

    return _both(gold, predicted, body)


def exact_match(a: Column | str, b: Column | str) -> Column:
    return (normalize_answer(a) == normalize_answer(b)).cast("double")


def multihop_scores(predicted: Column | str, gold: Column | str) -> Column:
    """struct(f1, precision, recall): all 0 without common words, and where yes, no or noanswer meets anything else."""
    single = F.array(*map(F.lit, ("yes", "no", "noanswer")))

    def body(g: Column, p: Column, n: Column) -> Column:
        # normalised texts are equal if their words are
        guard = (F.arrays_overlap(single, p) & (F.size(p) == 1) | F.arrays_overlap(single, g) & (F.size(g) == 1)) & (p != g)
        common = F.when(guard, 0).otherwise(n)
        some = common > 0
        return F.struct(
            _f1(common, F.size(p), F.size(g)).alias("f1"),
            F.when(some, common / F.size(p)).otherwise(0.0).alias("precision"),
            F.when(some, common / F.size(g)).otherwise(0.0).alias("recall"),
        )

    return _both(tokens(gold), tokens(predicted), body)


def condition_f1(predicted: Column, true: Column) -> Column:
    """Set F1 of conditions as they are written: 1 if none is true or predicted, 0 if only one side has some."""
    common = F.size(F.array_intersect(F.array_distinct(predicted), F.array_distinct(true)))
    by = F.when(common == 0, 0.0).otherwise(2.0 * (common / F.size(predicted)) * (common / F.size(true)) / (common / F.size(predicted) + common / F.size(true)))
    return F.when(F.size(true) == 0, (F.size(predicted) == 0).cast("double")).when(F.size(predicted) == 0, 0.0).otherwise(by)


def em_f1(predicted: Column, conditions: Column, ref: Column, ref_conditions: Column) -> Column:
    """struct(em, conditional_em, f1, conditional_f1) of one answer against one reference."""
    em, f1 = exact_match(predicted, ref), answer_f1(tokens(ref), tokens(predicted))
    cond = condition_f1(conditions, ref_conditions)
    return F.struct(em.alias("em"), (em * cond).alias("conditional_em"), f1.alias("f1"), (f1 * cond).alias("conditional_f1"))


def length_discount(predicted: Column, ref: Column) -> Column:
    """exp(1 - predicted / ref) for more answers than references, 1 otherwise; the shorter side is padded."""
    return F.when(predicted > ref, F.exp(1 - predicted / ref)).otherwise(1.0)


def parse_prediction(s: Column | str, qtype: Column | str) -> Column:
    """struct(answer, conditions) of a model's `Answer: ... Conditions: ...`.

    Types yes/no and span take what follows `Answer: `, or all of the text; for yes/no a
    yes or no between spaces stands for the answer. Conditional types need both marks,
    split conditions by line, and keep all of the text otherwise.
    """
    s, qtype = _c(s), _c(qtype)
    none = F.array().cast("array<string>")
    answer = F.when(F.contains(s, F.lit("Answer: ")), F.trim(F.try_element_at(F.split(s, "Answer: "), F.lit(2)))).otherwise(s)
    words = F.split(F.lower(answer), " ")
    named = F.when((qtype == "yes/no") & F.array_contains(words, "yes"), "yes").when((qtype == "yes/no") & F.array_contains(words, "no"), "no").otherwise(answer)
    before = F.element_at(F.split(s, "Conditions:"), 1)
    marked = F.contains(s, F.lit("Conditions: ")) & F.contains(before, F.lit("Answer:"))
    conditions = F.split(F.trim(F.try_element_at(F.split(s, "Conditions: "), F.lit(2))), "\n")
    long = F.trim(F.try_element_at(F.split(before, "Answer:"), F.lit(2)))
    plain = qtype.isin("yes/no", "span")
    return F.struct(F.when(plain, named).when(marked, long).otherwise(s).alias("answer"), F.when(~plain & marked, conditions).otherwise(none).alias("conditions"))


def _struct_answers(answers: Column, conditions: Column) -> Column:
    return F.transform(answers, lambda a: F.struct(a.alias("answer"), conditions.alias("conditions")))


def parse_yes_no(s: Column | str) -> Column:
    """Answers of a text prompt for a yes/no question: without either word, both."""
    low = F.lower(_c(s))
    none = F.array().cast("array<string>")
    found = F.when(F.contains(low, F.lit("yes")), F.array(F.lit("yes"))).when(F.contains(low, F.lit("no")), F.array(F.lit("no"))).otherwise(F.array(F.lit("yes"), F.lit("no")))
    return _struct_answers(found, none)


def parse_text_answer(s: Column | str, yes_no: Column, rationales: bool, conditions: bool) -> Column:
    """Answers of a text with `Answer: ` after its rationales and `. Conditions: ` with one a line, each if it is asked for and there; a yes/no question with another answer gets both, without conditions."""
    s, none = _c(s), F.array().cast("array<string>")
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    after = lambda x, mark: F.try_element_at(F.split(x, mark), F.lit(2))
    body = F.coalesce(strip(after(s, "Answer: ")), s) if rationales else s
    given = F.split(strip(after(body, "Conditions: ")), "\n") if conditions else F.lit(None).cast("array<string>")
    answer = F.when(given.isNotNull(), strip(F.element_at(F.split(body, r"\. Conditions:"), 1))).otherwise(body)
    both = yes_no & ~F.lower(answer).isin(*YES_NO)
    return F.when(both, _struct_answers(F.array(F.lit("yes"), F.lit("no")), none)).otherwise(_struct_answers(F.array(answer), F.coalesce(given, none)))


def parse_code_answer(s: Column | str, yes_no: Column) -> Column:
    """Answers of `# Answer: x` with `\\t if: c` lines; a yes/no question with another answer gets both, conditions kept."""
    lines = F.split(_c(s), "\n")
    answer = F.coalesce(F.try_element_at(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("# Answer: "))), lambda x: F.trim(F.substring(x, 11, 1 << 20))), F.lit(1)), F.lit(""))
    conditions = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("\t if: "))), lambda x: F.trim(F.substring(x, 7, 1 << 20)))
    both = yes_no & ~F.lower(answer).isin(*YES_NO)
    return _struct_answers(F.when(both, F.array(F.lit("yes"), F.lit("no"))).otherwise(F.array(answer)), conditions)


def braces(s: Column | str) -> Column:
    """Trimmed texts in braces, without a leading {Yes} or {No}."""
    bare = F.regexp_replace(_c(s), r"^\s*\{(?i:yes|no)\}\s*", "")
    return F.filter(F.transform(F.regexp_extract_all(bare, F.lit(r"\{(.*?)\}"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def first_brace(s: Column | str) -> Column:
    """The text between the first { and the first } after it; empty without."""
    return F.regexp_extract(_c(s), r"\{([^}]*)\}", 1)


def is_yes(s: Column | str) -> Column:
    return F.replace(F.trim(F.lower(_c(s))), F.lit(" "), F.lit("")) == "yes"


def sentence_case(s: Column) -> Column:
    """First letter in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 20)))


def clean_predicate(s: Column) -> Column:
    """Quotes around it off, listed marks and WHERE out, spaces as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^'+|'+$", ""), PREDICATE_NOISE, ""), r"\s+", " "))


def parse_triplets(s: Column | str, max_bytes: int = 1000) -> Column:
    """array<struct(head, rel, tail)> of `(a, b, c)` lines: three parts, none empty or above max_bytes."""
    inner = F.filter(F.transform(F.split(_c(s), "\n"), lambda x: F.regexp_extract(x, r"\(([^)]*)\)", 1)), lambda x: x != "")
    parts = F.transform(inner, lambda x: F.transform(F.split(x, ","), lambda p: F.trim(F.regexp_replace(F.trim(p), r"^\"+|\"+$", ""))))
    good = F.filter(parts, lambda p: (F.size(p) == 3) & F.forall(p, lambda x: (x != "") & (F.octet_length(x) <= max_bytes)))
    made = F.transform(good, lambda p: F.struct(sentence_case(p[0]).alias("head"), sentence_case(clean_predicate(p[1])).alias("rel"), sentence_case(p[2]).alias("tail")))
    return F.filter(made, lambda t: t["rel"] != "")


def parse_scored_triples(s: Column | str, least: int = 8) -> Column:
    """array<struct(head, rel, tail, score)> of `(a, b, c) (Score: n)`, bold or not: three parts and a score of at least `least`."""
    pattern = r"\((.*?)\)(?:\*\*)? \(Score: (\d+)\)"
    inner, scores = (F.regexp_extract_all(_c(s), F.lit(pattern), F.lit(k)) for k in (1, 2))
    # scores first, for the parts of what is dropped by them aren't needed; quotes lie on the one line that the pattern matches
    scored = F.filter(F.zip_with(inner, scores, lambda x, n: F.struct(x.alias("x"), n.cast("int").alias("score"))), lambda r: r["score"] >= least)
    parts = F.transform(scored, lambda r: F.struct(F.transform(F.split(r["x"], ","), lambda p: F.btrim(F.trim(p), F.lit("'\""))).alias("p"), r["score"].alias("score")))
    good = F.filter(parts, lambda r: F.size(r["p"]) == 3)
    return F.transform(good, lambda r: F.struct(r["p"][0].alias("head"), r["p"][1].alias("rel"), r["p"][2].alias("tail"), r["score"].alias("score")))


def parse_scored_relations(s: Column | str, head_relations: Column) -> Column:
    """array<struct(relation, score, is_head)> of `NAME (Score: x)`; direction by membership among head relations."""
    pattern = r"([A-Z_]+) \(Score: ([0-9]+\.[0-9]+)\)"
    names, scores = (F.regexp_extract_all(_c(s), F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(names, scores, lambda n, x: F.struct(n.alias("relation"), x.cast("double").alias("score"), F.array_contains(head_relations, n).alias("is_head")))


def parse_scores(s: Column | str, n: Column) -> Column:
    """Decimal numbers of the text, or n times 1/n if there are not n."""
    found = F.transform(F.regexp_extract_all(_c(s), F.lit(r"\d+\.\d+"), F.lit(0)), lambda x: x.cast("double"))
    return F.when(F.size(found) == n, found).otherwise(F.array_repeat(1.0 / n, n.cast("int")))


def keywords(s: Column | str) -> Column:
    """Distinct keywords: after `KEYWORDS:` if there, of the first line, between commas."""
    body = F.regexp_replace(_c(s), r"^.*KEYWORDS:\s*", "")
    return F.array_distinct(F.filter(F.transform(F.split(F.element_at(F.split(body, "\n"), 1), ","), lambda x: F.trim(x)), lambda x: x != ""))


def without_stop_word(s: Column) -> Column:
    """Lower case without punctuation; empty if the whole of it is a stop word."""
    return no_stop_word(without_punctuation(s))


def without_punctuation(s: Column) -> Column:
    return F.trim(F.translate(F.lower(s), PUNCTUATION, ""))


def no_stop_word(bare: Column) -> Column:
    return F.when(bare.isin(*STOP_WORDS), "").otherwise(bare)


def search_words(s: Column, visited: Column | None = None) -> Column:
    """Words to search a graph with: lower case, no stop words, no dots, none that was visited."""
    words = F.filter(F.transform(F.split(F.lower(s), " "), lambda w: F.replace(w, F.lit("."), F.lit(""))), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_except(words, visited) if visited is not None else F.array_distinct(words)


def kg_text(s: Column) -> Column:
    """A graph's name as text: trimmed, underscores as spaces, lower case."""
    return F.lower(F.replace(F.trim(s), F.lit("_"), F.lit(" ")))


def question_type(answers: Column) -> Column:
    """Type by answers array<struct(answer, conditions)>: any yes or no answer, any conditions, none at all."""
    yes = F.exists(answers, lambda a: a["answer"].isin(*YES_NO))
    conditional = F.exists(answers, lambda a: F.size(a["conditions"]) > 0)
    return F.when(F.size(answers) == 0, "unanswerable").when(yes & conditional, "yes/no_conditional").when(yes, "yes/no").when(conditional, "span_conditional").otherwise("span")


def first_answer_type(answers: Column) -> Column:
    """The same by the first answer alone; none is a span."""
    first = F.try_element_at(answers, F.lit(1))
    yes = F.coalesce(first["answer"].isin(*YES_NO), F.lit(False))
    conditional = F.coalesce(F.size(first["conditions"]) > 0, F.lit(False))
    return F.when(yes & conditional, "yes/no_conditional").when(yes, "yes/no").when(conditional, "span_conditional").otherwise("span")


def unescape(s: Column | str) -> Column:
    """\\n, \\t, quotes and backslashes written as escapes, as what they stand for."""
    out = _c(s)
    for written, meant in (("\\\\n", "\n"), ("\\\\t", "\t"), ("\\\\\"", "\""), ("\\\\'", "'")):
        out = F.regexp_replace(out, written, meant)
    return out


def says_yes_no(s: Column | str) -> Column:
    """yes if the text has it, else no if it has that, else an error."""
    low = F.lower(_c(s))
    return F.when(F.contains(low, F.lit("yes")), True).when(F.contains(low, F.lit("no")), False).otherwise(F.raise_error(F.lit("neither yes nor no")).cast("boolean"))


def path_text(path: Column) -> Column:
    """array<struct(head, rel, tail)> as `h, r, t --> h, r, t`."""
    return F.array_join(F.transform(path, lambda t: F.concat_ws(", ", t["head"], t["rel"], t["tail"])), " --> ")


def search_pattern(words: list[str], whole: bool = False) -> str:
    """A regular expression that finds any of the words, escaped: anywhere, or as the whole text."""
    import re

    body = "|".join(map(re.escape, words)) or "(?!)"
    return f"(?i)^(?:{body})$" if whole else f"(?i)(?:{body})"


def linear_triples(s: Column | str) -> Column:
    """array<struct(head, rel, tail)> of `<triplet> head <subj> tail <obj> relation ...`: each <subj> part gives one."""
    parts = F.filter(F.split(F.regexp_replace(_c(s), r"<s>|<pad>|</s>", ""), r"<triplet>"), lambda x: F.contains(x, F.lit("<subj>")))
    head = lambda x: F.trim(F.element_at(F.split(x, "<subj>"), 1))
    tails = lambda x: F.filter(F.slice(F.split(x, "<subj>"), 2, 1 << 20), lambda y: F.contains(y, F.lit("<obj>")))
    return F.flatten(F.transform(parts, lambda x: F.transform(tails(x), lambda y: F.struct(head(x).alias("head"), F.trim(F.element_at(F.split(y, "<obj>"), 2)).alias("rel"), F.trim(F.element_at(F.split(y, "<obj>"), 1)).alias("tail")))))


#: Relations that lead to identifiers, and those that are abandoned.
NUMBER_SUFFIXES = (" ID", " code", " number", "instance of", "website", "URL", "inception", "image", " rate", " count")
ABANDONED_STARTS, ABANDONED_PARTS = ("type.object.type", "type.object.name", "common.", "freebase."), ("sameAs",)


def is_identifier_relation(s: Column) -> Column:
    return s.rlike("(" + "|".join(NUMBER_SUFFIXES) + ")$")


def is_abandoned_relation(s: Column) -> Column:
    out = F.lit(False)
    for x in ABANDONED_STARTS:
        out = out | F.startswith(s, F.lit(x))
    for x in ABANDONED_PARTS:
        out = out | F.contains(s, F.lit(x))
    return out


def entity_name(s: Column) -> Column:
    """An entity's or a relation's address without scheme and www."""
    return F.regexp_replace(s, r"^https?://(www\.)?", "")
