"""Rule expressions over query texts: attack and personal-data patterns, features, routing and policy signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import sanitize_query, words

#: Patterns of attacks, by category, and of personal data, in the order in which they are applied.
ATTACKS = [
    ("prompt_injection", r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+instructions"),
    ("prompt_injection", r"(reveal|show|output|print|display).{0,40}(system prompt|hidden prompt|developer prompt|chain of thought|internal instructions?)"),
    ("prompt_injection", r"(forget|bypass|override|disable).{0,40}(rules|instructions|policy|guardrails|filters|safety)"),
    ("prompt_injection", r"\byou are now\b"),
    ("prompt_injection", r"\bact as\b.{0,50}\b(without|ignore|bypass)\b"),
    ("prompt_injection", r"(simulate|pretend).{0,40}(no restrictions|no guardrails|developer mode|jailbreak)"),
    ("prompt_injection", r"\bdo not follow\b.{0,30}(system|developer|safety)"),
    ("jailbreak_attempt", r"\b(jailbreak|developer mode|god mode|DAN)\b"),
    ("data_exfiltration", r"(show|print|dump|reveal|display|expose).{0,40}(api key|secret|token|credential|password|private key)"),
    ("data_exfiltration", r"(return|leak|extract|copy).{0,40}(environment variables|secrets|credentials|keys)"),
    ("pii_exfiltration", r"(list|dump|reveal|show|extract).{0,40}(ssn|social security|passport|email addresses|phone numbers|credit cards?)"),
    ("unsafe_capability", r"(malware|ransomware|virus|keylogger)"),
    ("unsafe_capability", r"how to (hack|exploit|bypass authentication|steal credentials)"),
]
PII = [
    ("email_address", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("phone_number", r"(?:(?<=\s)|^)(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?){2,4}\d{3,4}(?=\s|$)"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b(?:\d[ -]*?){13,19}\b"),
    ("iban", r"(?i)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
    ("ipv4_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("api_key", r"\b(?:sk-[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z\-_]{20,})\b"),
]
#: Words and phrases of the query features.
COMPARISON = r"(?i)\b(compare|compared with|versus|vs\.?|difference between)\b"
EXPLANATION = r"(?i)\b(why|how|explain|drivers|driver|trend|trends|context|governance|responsibilities|overview|strategy)\b"
MULTI_INTENT = r"(?i)\b(and|also|plus|as well as)\b"
SHORT = r"^\s*\S+(?:\s+\S+){0,4}\s*[?]?\s*$"
AMBIGUOUS = r"(?i)\b(the company|company|they|them|their|it|its|those|these|management|executives|board)\b"
SPARSE = r"(?i)\b(revenue|growth|margin|income|capex|datacenter|ai|azure|ceo|cfo|risk|governance)\b"
REFERENCE = r"(?i)\b(it|they|them|their|that|those|same|former|latter|that segment|that product|that geography|fastest-growing segment)\b"
#: Patterns of the routing signals, by family.
ROUTING = {
    "executive_role": [r"\bceo\b", r"\bcfo\b", r"\bcto\b", r"\bcoo\b", r"\bchief executive officer\b", r"\bchief financial officer\b", r"\bchief technology officer\b", r"\bchief operating officer\b", r"\bexecutive officer\b", r"\bsenior officer\b", r"\bpresident\b", r"\bchair(man|woman|person)?\b", r"\bfounder\b"],
    "numeric": [r"\bhighest\b", r"\blowest\b", r"\baverage\b", r"\bavg\b", r"\btotal\b", r"\bsum\b", r"\bcompare\b", r"\bcomparison\b", r"\brank\b", r"\bordered\b", r"\btop\b", r"\bpercentage\b", r"\bpct\b", r"\bgrowth\b", r"\brevenue\b", r"\bmargin\b", r"\bincome\b", r"\bhow many\b", r"\bwhat was\b"],
    "relationship": [r"\binclude[s]?\b", r"\bincluded under\b", r"\bpart of\b", r"\bbelong[s]?\b", r"\brelate to\b", r"\brelationship\b", r"\bsupport[s]?\b", r"\bdepend[s]?\b", r"\buse[s]?\b", r"\bintegrate[s]?\b", r"\bwhich segment\b.*\binclude"],
    "narrative": [r"\bhow does\b", r"\bwhy\b", r"\bexplain\b", r"\bdescribe\b", r"\bdiscuss\b", r"\bwhat did\b", r"\bwhat does\b", r"\bhow did management\b", r"\brisk\b", r"\bstrategy\b", r"\boutlook\b", r"\bcommentary\b", r"\bbusiness structure\b", r"\bnarrative driver\b", r"\bmentioned\b", r"\bproducts and services\b", r"\bsay about\b"],
    "metric": [r"\brevenue\b", r"\bgrowth\b", r"\bmargin\b", r"\bincome\b", r"\bpercentage\b", r"\bscore\b", r"\bmix\b"],
}
#: Phrases of the policy signals.
EXPLAIN_TERMS = ["explain", "why", "how does", "discuss", "strategy"]
QUOTE_TERMS = ["what did", "what does", "say about", "mentioned", "commentary"]
ROLE_TERMS = [" ceo", " cfo", " cto", " coo", "chief executive officer", "chief financial officer", "chief technology officer", "chief operating officer", "executive officer", "senior officer", "chairman", "chairperson", "president", "founder"]
MEMBER_TERMS = ["include", "included", "part of", "belongs"]


def flags(rules: list[tuple[Column, str]]) -> Column:
    """The labels of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(label)) for rule, label in rules]))


def attack_types(text: Column) -> Column:
    """Categories of the patterns that occur, in the order of the patterns."""
    return flags([(text.rlike(f"(?is){p}"), c) for c, p in ATTACKS])


def luhn(candidate: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of 10."""
    digits = F.regexp_replace(candidate, r"\D", "")
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.length(digits).between(13, 19) & (F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0)


def redact(text: Column, kinds: list[tuple[str, str]] = PII) -> Column:
    """Placeholders for personal data; each pattern sees what the ones before it left, a card number must pass Luhn."""
    for kind, pattern in kinds:
        mark = f"[REDACTED_{kind.upper()}]"
        if kind == "credit_card":
            found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), luhn)
            text = F.aggregate(found, text, lambda t, x: F.replace(t, x, F.lit(mark)))
        else:
            text = F.regexp_replace(text, pattern, mark.replace("$", ""))
    return sanitize_query(text)


def sub_query_count(query: Column, most: int = 3) -> Column:
    parts = F.size(F.filter(F.split(query, r"[?,]"), lambda x: F.trim(F.translate(x, ".?", "  ")) != ""))
    clauses = F.size(F.filter(F.split(query, r"(?i)\band\b|\balso\b|\bplus\b|\bas well as\b"), lambda x: F.trim(F.translate(x, ".?", "  ")) != ""))
    return F.when(query.rlike(COMPARISON), 1).when(parts > 1, F.least(parts, F.lit(most))).when(query.rlike(MULTI_INTENT), F.least(F.greatest(clauses, F.lit(1)), F.lit(most))).otherwise(1)


def query_features(query: Column) -> dict[str, Column]:
    n = sub_query_count(query)
    comparison, explains, refers, short = (query.rlike(p) for p in (COMPARISON, EXPLANATION, AMBIGUOUS, SHORT))
    signals = flags([
        (refers, "ambiguous_reference"),
        ((n > 1) & short, "short_but_multi_intent"),
        (explains & (n > 1), "mixed_explanatory_multi_intent"),
        ((n <= 1) & query.rlike(MULTI_INTENT) & ~comparison, "possible_hidden_multi_intent"),
    ])
    return {"is_comparison": comparison, "is_explanatory": explains, "has_ambiguous_refs": refers, "is_short": short, "is_sparse": query.rlike(SPARSE) & short, "estimated_sub_queries": n, "ambiguity_signals": signals}


def transform_gate(f: dict[str, Column]) -> dict[str, Column]:
    run = {
        "run_decomposition": f["estimated_sub_queries"] > 1,
        "run_multi_query": f["is_short"] | f["is_sparse"] | f["is_comparison"],
        "run_step_back": f["is_explanatory"] | f["is_comparison"],
        "run_hyde": f["is_sparse"] | (f["is_short"] & ~f["is_comparison"]),
    }
    why = ["compound_or_multi_intent", "needs_retrieval_variation", "needs_broader_context", "sparse_query_support"]
    return run | {"reasons": F.array_sort(flags(list(zip(run.values(), why))))}


def clause_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\b(?:and|or)\b|[?;,]"), lambda x: F.trim(x) != ""))


def with_routing_signals(rows: DataFrame, query: str) -> DataFrame:
    """Adds how many patterns of each family a query has, and what follows from that. The counts are a step of their own, made once."""
    text = F.lower(F.trim(query))
    hits = {f"{k}_signal_count": F.size(F.filter(F.array(*[text.rlike(p) for p in ps]), lambda x: x)) for k, ps in ROUTING.items()}
    rows = rows.withColumns(hits | {"word_count": F.size(words(text)), "clause_count": clause_count(text), "_segment": text.rlike(r"\b(segment|reporting segment)\b")})
    kinds = sum((F.when(F.col(f"{k}_signal_count") > 0, 1).otherwise(0) for k in ("numeric", "relationship", "narrative")), F.lit(0))
    return rows.withColumns({"membership": F.col("_segment") & (F.col("relationship_signal_count") > 0), "looks_multi_source": kinds >= 2}).drop("_segment")


def any_of(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def policy_signals(query: Column) -> dict[str, Column]:
    text = F.lower(F.trim(query))
    return {
        "word_count": F.size(words(text)),
        "has_reference": query.rlike(REFERENCE),
        "asks_for_explanation": any_of(text, EXPLAIN_TERMS),
        "asks_for_quote": any_of(text, QUOTE_TERMS),
        "asks_for_role": any_of(text, ROLE_TERMS),
        "asks_membership": text.contains("segment") & any_of(text, MEMBER_TERMS),
        "is_multi_clause": clause_count(text) > 1,
    }
