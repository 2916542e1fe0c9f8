"""Spans: detectors with offsets, overlap joins by buckets, merge groups, corrections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docspark.operators import spans as span_ops
from docspark.operators.tables import written
from docspark.plans.dialect import SPARK, frame, plan, rows, table, views
from docspark.plans.layout import sentences

BUCKET = 64
# Detectors of terms that no correction may touch, by pattern (with a shape that the whole match must have) and
# by whole word, in the order in which they claim a span. Borders of words are those of the tokens.
BY_PATTERN = {
    "url": (r"(?i:https?://|www\.)\S+", None), "email": (r"[\w.+-]+@[\w-]+\.[\w.-]+", None), "citation": (r"\([A-Z][a-zA-Z]+(?:\s(?:&|and)\s[A-Z][a-zA-Z]+)?,?\s*\d{4}[a-z]?\)|\[\d+(?:,\s*\d+)*\]|et al\.", None),
    "math": (r"[\p{L}\p{N}_]+[-+*/^=<>]+[\p{L}\p{N}_]+|\\(?:softmax|matmul|sin|cos|tan|log|exp|sqrt|cdot|approx|le|ge|sum|prod|alpha|beta|gamma|theta|lambda|sigma|pi|mu)", None),
    "scientific": (r"\d+(?:\.\d+)?[eE][+-]?\d+|\d+\^[-+]?\d+", None), "file_name": (r"[\p{L}\p{N}_-]+\.[\p{L}\p{N}_]+", r"^[A-Za-z0-9_-]+\.[a-zA-Z0-9]{1,4}$"),
    "person": (r"(?:Dr|Prof|Mr|Mrs|Ms)\.\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*|[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){1,2}", None),
}
LIBRARIES = "python java c javascript html css pytorch tensorflow numpy scipy spacy symspell languagetool docling fitz docx requests transformers vennify t5 ollama jvm jdk jre"
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
TECHNICAL = (
    "attention encoder decoder transduction transformer sublayer dimension perplexity softmax residual normalization embeddings hyperparameters dropout bleu adam tensor codebase convolutional recurrent recurrents convolutions "
    "sequence sequences checkpoint tokenization tokens token vector vectors matrix matrices gradient gradients backpropagation neural network networks linear projection projections weight weights bias biases layer layers "
    "learning rate rates epoch epochs batch batches dataset datasets corpus corpora vocabulary vocabularies embedding parameters parameter activation activations regularization optimizer optimizers loss losses "
    "training inference architectures architecture model models baseline baselines feedforward layernorm tensor2tensor deep machine translation nlp ai seq2seq convseq"
)
PERSONAL = "i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves"
one_of = lambda words: "(?i)^(" + words.replace(" ", "|") + ")$"
BY_WORD = {
    "roman": r"^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$", "acronym": r"^[A-Z]{2,}s?$", "mixed_case": r"^[a-zA-Z]*[a-z][A-Z][a-zA-Z]*$|^[A-Za-z0-9_]*\d[A-Za-z0-9_]*[a-zA-Z][A-Za-z0-9_]*$", "subscript": r"^[a-zA-Z]+_[a-zA-Z0-9]+$",
    "library": one_of(LIBRARIES), "greek": one_of(GREEK), "variable": r"^[b-zB-HJ-Z]$", "technical": one_of(TECHNICAL), "pronoun": one_of(PERSONAL),
}
ORDER = ("url", "email", "citation", "roman", "acronym", "mixed_case", "math", "subscript", "library", "greek", "scientific", "file_name", "variable", "first_page", "technical", "person", "pronoun")
#: So many common terms go to all tasks; more are joined by a shuffle.
TERMS_AT_ONCE = 1_000_000
FIRST_PAGE, CAPITALISED, COMMON = 2500, "^[A-ZŁŚŹŻĆŃÓ][a-zA-Złśźżćńó']+$", 100
OPEN, SHUT = span_ops.OPEN, span_ops.SHUT
WORDS, MARKED = r"[\p{L}\p{N}_]+", "[^ ]+!!"
# What a repeated word may look like, hyphens and apostrophes inside.
WORD_TOKEN, WORD_SHAPE = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?", "^[A-Za-z][A-Za-z'-]{2,}$"


# What a text must have for a match, told at less cost.
CUES = {
    "url": r"://|[wW]{3}\.", "email": "@", "citation": r"\([A-Z]|\[\d|et al\.", "math": r"[-+*/^=<>][\p{L}\p{N}_]|\\", "scientific": r"\d(?:[eE][-+]?\d|\^)", "file_name": r"\.[\p{L}\p{N}_]",
    "person": r"[a-zA-Z]\s+[A-Z][a-zA-Z]|(?:Dr|Prof|Mrs?|Ms)\.", "marked": "!!",
}


def _looked_at() -> str:
    """Whole words that a detector may look at: those with a capital, digit or underscore, long ones, single letters, listed ones.

    The letter beyond the first plane is one of ``\\p{L}``; with one in sight, lookbehinds step over such letters whole.
    """
    word, heads = r"[\p{L}\p{N}_]", {}
    for w in sorted({*LIBRARIES.split(), *GREEK.split(), *TECHNICAL.split(), *PERSONAL.split()}):
        heads.setdefault(w[0], []).append(w[1:])
    listed = "|".join(f"{c}(?:{'|'.join(tails)})" for c, tails in heads.items())
    return f"(?<![\\p{{L}}\\p{{N}}_\U00020000])(?={CAPITALISED[1:-1].split(']')[0]}]|[a-zA-Z0-9_]*?[A-Z0-9_]|{word}{{14}}|[b-z](?!{word})|(?i:{listed})(?!{word})){word}+"


def found(d, pattern: str, source: str = "documents") -> str:
    """Matches of a pattern: doc_id, char_start, char_end, text; linear in the text's length."""
    marked = d.sub("coalesce(text, '')", f"({pattern})", OPEN + d.group(1) + SHUT)
    bare = f"replace(piece, {d.text(SHUT)}, '')"
    start = f"sum(length({bare})) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    word = f"substr(piece, 1, {d.int(f'''strpos(piece, {d.text(SHUT)})''' if d.__class__.__name__ == 'DuckSql' else f'''instr(piece, {d.text(SHUT)})''')} - 1)"
    inner = f"SELECT doc_id, pos, {start} AS char_start, {word} AS text FROM {source} {d.each(d.split(marked, OPEN), 'piece', 'pos')}"
    return f"SELECT doc_id, {d.long('char_start')} AS char_start, {d.long('char_start + length(text)')} AS char_end, text FROM ({inner}) m WHERE pos > 0"


def words(d) -> str:
    return found(d, WORDS)


def protected(d) -> str:
    return d.stored("protected_spans", protected_sql)


def candidates(d) -> str:
    return d.stored("candidate_spans", candidates_sql)


def merged(d) -> str:
    return d.stored("merged_issues", merged_sql)


def common_sql(d) -> str:
    """The corpus's own frequency dictionary: words used over COMMON times."""
    return f"SELECT term FROM (SELECT lower(text) AS term, count(*) AS freq FROM ({words(d)}) w GROUP BY lower(text)) t WHERE freq > {COMMON}"


def matches_sql(d) -> str:
    """Matches of all patterns that any detector reads: doc_id, pattern, char_start, char_end, text."""
    return " UNION ALL ".join(f"SELECT doc_id, '{name}' AS pattern, char_start, char_end, text FROM ({found(d, p)}) m" for name, p in _patterns().items())


def matches(d) -> str:
    return d.stored("span_matches", matches_sql)


def _patterns() -> dict[str, str]:
    return {name: p for name, (p, _) in BY_PATTERN.items()} | {"word": WORDS, "marked": MARKED}


def claimed(d) -> str:
    """Every detector's spans, with its place in the order."""
    shape = " AND ".join(f"(pattern <> '{name}' OR {d.like('text', p)})" for name, (_, p) in BY_PATTERN.items() if p)
    at = lambda name: ORDER.index(name)
    by_pattern = f"SELECT doc_id, char_start, char_end, text, pattern AS reason, CASE pattern {' '.join(f'WHEN {d.text(n)} THEN {at(n)}' for n in BY_PATTERN)} END AS ord FROM ({matches(d)}) m WHERE pattern NOT IN ('word', 'marked', 'person') AND length(text) >= 2 AND {shape}"
    names = sorted(BY_WORD, key=at)
    which = " ".join(f"WHEN {d.like('text', BY_WORD[n])} THEN '{n}'" for n in names)
    by_word = f"SELECT doc_id, char_start, char_end, text, reason, CASE reason {' '.join(f'WHEN {d.text(n)} THEN {at(n)}' for n in names)} END AS ord FROM (SELECT doc_id, char_start, char_end, text, CASE {which} END AS reason FROM ({matches(d)}) m WHERE pattern = 'word') x WHERE reason IS NOT NULL"
    first = lambda name, where, word: f"SELECT m.doc_id, m.char_start, m.char_end, m.text, '{name}' AS reason, {at(name)} AS ord FROM ({matches(d)}) m LEFT JOIN ({d.stored('common_words', common_sql)}) c ON c.term = {word} WHERE {where} AND c.term IS NULL"
    page = first("first_page", f"m.pattern = 'word' AND m.char_start < {FIRST_PAGE} AND {d.like('m.text', CAPITALISED)}", "lower(m.text)")
    person = first("person", "m.pattern = 'person'", f"lower({d.extract('m.text', '^[A-Za-z]+', 0)})")
    return " UNION ALL ".join((by_pattern, by_word, page, person))


def protected_sql(d) -> str:
    """All detectors' spans; the first detector keeps a span that several find."""
    return f"SELECT doc_id, char_start, char_end, text, reason, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, char_start, char_end ORDER BY ord) AS rn FROM ({claimed(d)}) a) b WHERE rn = 1"


def candidates_sql(d) -> str:
    """Correction candidates of three detectors, with an ordinal in each document."""
    some = lambda where, put, source, kind: f"SELECT doc_id, char_start, char_end, text, {put} AS suggestion, '{source}' AS source, '{kind}' AS issue_type FROM ({matches(d)}) m WHERE {where}"
    spell = some("pattern = 'word' AND length(text) >= 14", "lower(text)", "symspell", "spelling")
    marks = some("pattern = 'marked'", d.sub("text", "!+$", ""), "languagetool", "punctuation")
    caps = some(f"pattern = 'word' AND {d.like('text', '^[A-Z]{6,}$')}", "lower(text)", "llm", "style")
    return f"SELECT *, {d.int('row_number() OVER (PARTITION BY doc_id ORDER BY char_start, char_end, source)')} AS ord FROM ({spell} UNION ALL {marks} UNION ALL {caps}) c"


def bucketed(d, spans: str) -> str:
    """Spans once for each bucket of positions that they touch."""
    series = f"sequence({d.int(f'floor(char_start / {BUCKET})')}, {d.int(f'floor((char_end - 1) / {BUCKET})')})" if d.__class__.__name__ == "SparkSql" else f"range({d.int(f'floor(char_start / {BUCKET})')}, {d.int(f'floor((char_end - 1) / {BUCKET})')} + 1)"
    return f"SELECT s.*, bucket FROM ({spans}) s {d.each(series, 'bucket', '_at')}"


def gated(d) -> str:
    """Candidates with the first protected span that they overlap."""
    hits = f"""SELECT c.doc_id, c.ord, min_by(p.reason, p.char_start * 100 + p.ord) AS reason FROM ({bucketed(d, candidates(d))}) c
    JOIN ({bucketed(d, protected(d))}) p ON c.doc_id = p.doc_id AND c.bucket = p.bucket AND c.char_start < p.char_end AND c.char_end > p.char_start GROUP BY c.doc_id, c.ord"""
    return f"SELECT c.*, h.reason IS NOT NULL AS is_protected, h.reason AS protected_reason FROM ({candidates(d)}) c LEFT JOIN ({hits}) h ON c.doc_id = h.doc_id AND c.ord = h.ord"


def grouped(d) -> str:
    """Merge groups: a new one where a candidate starts at or after the end of all before."""
    new = "CASE WHEN char_start >= coalesce(max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END"
    return f"SELECT *, {d.int('sum(is_new) OVER (PARTITION BY doc_id ORDER BY char_start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS grp FROM (SELECT *, {new} AS is_new FROM ({gated(d)}) g) h"


def merged_sql(d) -> str:
    """One issue for each group: the best candidate by source, its agreement, confidence and severity."""
    prio = "CASE source WHEN 'llm' THEN 0 WHEN 'languagetool' THEN 1 ELSE 2 END"
    best = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY {prio}, char_start, ord) AS rn FROM ({grouped(d)}) g) b WHERE rn = 1"
    agree = f"SELECT b.doc_id, b.grp, count(*) AS agreement, max(CASE WHEN g.source = 'llm' THEN 1 ELSE 0 END) AS llm, max(CASE WHEN g.source = 'languagetool' THEN 1 ELSE 0 END) AS lt, max(CASE WHEN g.source = 'symspell' THEN 1 ELSE 0 END) AS ss FROM ({best}) b JOIN ({grouped(d)}) g ON b.doc_id = g.doc_id AND b.grp = g.grp AND b.suggestion = g.suggestion GROUP BY b.doc_id, b.grp"
    return judged(d, f"SELECT b.*, a.agreement AS n_agree, a.llm, a.lt, a.ss FROM ({best}) b JOIN ({agree}) a ON b.doc_id = a.doc_id AND b.grp = a.grp")


def judged(d, best: str) -> str:
    """Confidence and severity of each group's best candidate, from the detectors that agree with it."""
    # Confidence by the detectors that agree, weight by issue type, severity by their product.
    conf = "CASE WHEN is_protected THEN 0.0 WHEN lt + llm + ss = 3 THEN 1.0 WHEN lt + llm = 2 THEN 0.95 WHEN lt + ss = 2 THEN 0.88 WHEN ss + llm = 2 THEN 0.82 WHEN lt = 1 THEN CASE issue_type WHEN 'spelling' THEN 0.78 WHEN 'grammar' THEN 0.73 ELSE 0.75 END WHEN llm = 1 THEN 0.80 WHEN ss = 1 THEN 0.35 ELSE 0.5 END"
    weight = "CASE issue_type WHEN 'spelling' THEN 0.7 WHEN 'punctuation' THEN 0.6 WHEN 'style' THEN 0.5 ELSE 1.0 END"
    core = f"SELECT doc_id, grp, char_start, char_end, text, suggestion, source, issue_type, is_protected, n_agree AS agreement, CAST({conf} AS DOUBLE) AS confidence FROM ({best}) b"
    score = f"confidence * {weight}"
    return f"SELECT *, CASE WHEN {score} >= 0.85 THEN 'critical' WHEN {score} >= 0.65 THEN 'high' WHEN {score} >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM ({core}) m"


def applied(d, before: str, between: str, after: str, source: str) -> str:
    """Texts with spans replaced: ``before``, ``between`` and ``after`` are put together for each span of ``source``."""
    gap = "substr(t.text, CAST(coalesce(lag(s.char_end) OVER (PARTITION BY s.doc_id ORDER BY s.char_start), 0) AS INT) + 1, CAST(s.char_start - coalesce(lag(s.char_end) OVER (PARTITION BY s.doc_id ORDER BY s.char_start), 0) AS INT))"
    part = f"SELECT s.doc_id, s.char_start, s.char_end, concat({gap}, {before}, {between}, {after}) AS part FROM ({source}) s JOIN documents t ON s.doc_id = t.doc_id"
    put = f"SELECT doc_id, {d.strings('part', '', 'char_start')} AS head, max(char_end) AS last FROM ({part}) p GROUP BY doc_id"
    return f"SELECT t.doc_id, concat(coalesce(p.head, ''), substr(t.text, CAST(coalesce(p.last, 0) AS INT) + 1)) AS text FROM documents t LEFT JOIN ({put}) p ON t.doc_id = p.doc_id"


def repeated_sql(d) -> str:
    """``a4_repeated_terms`` in SQL alone."""
    token = f"SELECT * FROM ({found(d, WORD_TOKEN)}) w WHERE {d.like('text', WORD_SHAPE)}"
    tf = f"SELECT doc_id, lower(text) AS term, count(*) AS n FROM ({token}) w GROUP BY doc_id, lower(text) HAVING count(*) >= 2"
    df = f"SELECT lower(text) AS term, count(*) AS freq FROM ({token}) w GROUP BY lower(text)"
    kind = "CASE WHEN f.freq >= 3 THEN 'valid term' ELSE 'proper noun/code' END"
    return f"SELECT w.doc_id, w.char_start, w.char_end, w.text, concat('repeated ', t.n, 'x ', {kind}) AS reason FROM ({token}) w JOIN ({tf}) t ON w.doc_id = t.doc_id AND lower(w.text) = t.term JOIN ({df}) f ON t.term = f.term WHERE f.freq <= 100 AND (f.freq >= 3 OR {d.like('w.text', '[A-Z]')})"


@plan
def a4_repeated_terms(d):
    """Words that a document repeats and that aren't common: known ones wherever they stand, others where they have a capital.

    The frequency dictionary is the corpus's own: words used three times or more are known, over a hundred times common.
    """
    return d.stored("repeated_terms", repeated_sql)


@plan
def f26_pattern_spans(d):
    return f"SELECT reason, doc_id, char_start, char_end, text FROM ({claimed(d)}) c WHERE reason IN ({', '.join(map(d.text, BY_PATTERN))})"


@plan
def f27_word_spans(d):
    return f"SELECT doc_id, char_start, char_end, text, reason AS kind FROM ({claimed(d)}) c WHERE reason IN ({', '.join(map(d.text, (*BY_WORD, 'first_page')))})"


@plan
def u1_protected_terms(d):
    """The union of all detectors, words that a document repeats last; the first detector keeps a span."""
    every = f"SELECT doc_id, char_start, char_end, text, reason, ord FROM ({protected(d)}) p UNION ALL SELECT doc_id, char_start, char_end, text, 'repeated', {len(ORDER)} FROM ({a4_repeated_terms(d)}) r"
    return f"SELECT doc_id, char_start, char_end, text, reason FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, char_start, char_end ORDER BY ord) AS rn FROM ({every}) e) x WHERE rn = 1"


@plan
def u2_candidates(d):
    return f"SELECT * FROM ({candidates(d)}) c"


@plan
def j1_protected_gate(d):
    return f"SELECT doc_id, ord, is_protected, protected_reason FROM ({gated(d)}) g"


@plan
def p5_gate_split(d):
    return f"SELECT doc_id, {d.long('count_if(is_protected)')} AS rejected, {d.long('count_if(NOT is_protected)')} AS accepted FROM ({gated(d)}) g GROUP BY doc_id"


@plan
def j5_unflagged(d):
    """Words of the spelling detector that no other candidate overlaps."""
    other = f"SELECT DISTINCT a.doc_id, a.ord FROM ({bucketed(d, candidates(d))}) a JOIN ({bucketed(d, candidates(d))}) b ON a.doc_id = b.doc_id AND a.bucket = b.bucket AND b.source <> 'symspell' AND a.char_start < b.char_end AND a.char_end > b.char_start"
    return f"SELECT c.doc_id, c.ord, c.text FROM ({candidates(d)}) c LEFT JOIN ({other}) o ON c.doc_id = o.doc_id AND c.ord = o.ord WHERE c.source = 'symspell' AND o.ord IS NULL"


@plan
def j3_candidate_sentence(d):
    """The sentence that holds a candidate's start, -1 if none: the last sentence that begins at or before it."""
    both = f"SELECT doc_id, char_start, 0 AS kind, sentence_id, char_end AS stop, 0 AS ord FROM ({sentences(d)}) s UNION ALL SELECT doc_id, char_start, 1, NULL, NULL, ord FROM ({candidates(d)}) c"
    frame_ = "PARTITION BY doc_id ORDER BY char_start, kind, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    seen = f"SELECT doc_id, ord, kind, char_start, {d.last_seen('sentence_id', frame_)} AS sid, {d.last_seen('stop', frame_)} AS stop FROM ({both}) b"
    return f"SELECT doc_id, ord, CASE WHEN char_start < stop THEN sid ELSE -1 END AS sentence_id FROM ({seen}) s WHERE kind = 1"


@plan
def p8_real_changes(d):
    """Candidates that change something, with their text found again: at their offsets, else first within 20 characters.

    Offsets are moved by up to 24 characters here, as if the text had changed; candidates that aren't found again go.
    """
    moved = f"SELECT doc_id, ord, text, suggestion, greatest(char_start + (ord * 7) % 49 - 24, 0) AS a, length(text) AS n FROM ({candidates(d)}) c WHERE text <> suggestion"
    from_ = "greatest(c.a - 20, 0)"
    find = "strpos" if d.__class__.__name__ == "DuckSql" else "instr"
    window = f"substr(t.text, {d.int(from_)} + 1, {d.int(f'least(c.a + c.n + 20, length(t.text)) - {from_}')})"
    at = f"CASE WHEN substr(t.text, {d.int('c.a')} + 1, {d.int('c.n')}) = c.text THEN c.a ELSE nullif({find}({window}, c.text), 0) + {from_} - 1 END"
    found_ = f"SELECT c.doc_id, c.ord, c.n, {d.long(at)} AS char_start FROM ({moved}) c JOIN documents t ON c.doc_id = t.doc_id"
    return f"SELECT doc_id, ord, char_start, char_start + n AS char_end FROM ({found_}) f WHERE char_start IS NOT NULL"


@plan
def f33_located_quotes(d):
    """Quotes that a model gives back in order, located: the nth answer of one text is its nth place in the document.

    The answers are the documents' words of twelve letters or more, in their order, without places, and one too many of each.
    """
    places = f"SELECT doc_id, text, char_start, char_end, row_number() OVER (PARTITION BY doc_id, text ORDER BY char_start) AS nth FROM ({words(d)}) w WHERE length(text) >= 12"
    answers = f"SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id, text ORDER BY again) AS nth FROM (SELECT doc_id, text, 0 AS again FROM ({places}) p UNION ALL SELECT DISTINCT doc_id, text, 1 FROM ({places}) q) a"
    return f"SELECT a.doc_id, a.text, {d.long('a.nth')} AS nth, coalesce(p.char_start, -1) AS char_start, coalesce(p.char_end, -1) AS char_end FROM ({answers}) a LEFT JOIN ({places}) p ON a.doc_id = p.doc_id AND a.text = p.text AND a.nth = p.nth"


@plan
def w5_merge_groups(d):
    return f"SELECT doc_id, grp, count(*) AS n, min(char_start) AS char_start, max(char_end) AS char_end FROM ({grouped(d)}) g GROUP BY doc_id, grp"


@plan
def w6_merged_issues(d):
    return f"SELECT doc_id, grp, char_start, char_end, suggestion, source, issue_type, agreement, confidence, severity FROM ({merged(d)}) m"


@plan
def p9_confident_issues(d):
    return f"SELECT doc_id, grp, confidence FROM ({merged(d)}) m WHERE confidence > 0.5"


@plan
def a3_issue_counts(d):
    return f"SELECT issue_type, severity, count(*) AS n FROM ({merged(d)}) m GROUP BY issue_type, severity"


def f32_sql(d):
    text = applied(d, "''", "s.suggestion", "''", f"SELECT * FROM ({merged(d)}) m WHERE confidence > 0.5")
    return f"SELECT doc_id, md5(text) AS digest, {d.int('length(text)')} AS n_chars FROM ({text}) x"


def f30_sql(d):
    text = applied(d, "'[['", "s.text", "concat('=>', s.suggestion, ']]')", f"SELECT * FROM ({merged(d)}) m WHERE confidence > 0.5")
    return f"SELECT doc_id, md5(text) AS digest, {d.int('length(text)')} AS n_chars FROM ({text}) x"


def _replaced(spark, sf_dir, put):
    sql = f"SELECT * FROM ({merged(SPARK)}) m WHERE confidence > 0.5"
    views(spark, sf_dir, sql)
    spans = spark.sql(sql).select("doc_id", "char_start", "char_end", put.alias("put"))
    texts = span_ops.replaced(spark.read.parquet(f"{sf_dir}/documents.parquet"), spans)
    return texts.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


@frame(f32_sql)
def f32_corrected_text(spark, sf_dir):
    return _replaced(spark, sf_dir, F.col("suggestion"))


@frame(f30_sql)
def f30_annotated_text(spark, sf_dir):
    return _replaced(spark, sf_dir, F.concat(F.lit("[["), "text", F.lit("=>"), "suggestion", F.lit("]]")))


@table("span_matches")
def span_matches(spark, sf_dir):
    """``matches_sql`` in one pass over the documents, without the words that no detector looks at."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # few files: patterns cost far more than dealing texts out
        docs = docs.repartition(cores)
    got = span_ops.found(docs, _patterns() | {"word": _looked_at()}, cues=CUES)
    some = [f"text rlike {SPARK.text(p)}" for p in (*BY_WORD.values(), "^[A-Z]{6,}$")]
    return got.where(f"pattern <> 'word' or length(text) >= 14 or char_start < {FIRST_PAGE} and text rlike {SPARK.text(CAPITALISED)} or {' or '.join(some)}")


def _by_sql(name, sql):
    @table(name)
    def made(spark, sf_dir):
        views(spark, sf_dir, sql(SPARK))
        return spark.sql(sql(SPARK))


_by_sql("protected_spans", protected_sql)
_by_sql("candidate_spans", candidates_sql)


@table("common_words")
def common_words(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("term")).where("term <> ''").groupBy("term").count().where(f"count > {COMMON}").select("term")


@table("repeated_terms")
def repeated_terms(spark, sf_dir):
    """``repeated_sql`` with only the tokens dealt out whose term isn't common; a term that isn't has ``COMMON`` rows at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    if docs.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        docs = docs.repartition(cores)
    shaped = lambda df: df.where(F.col("text").rlike(WORD_SHAPE)).withColumn("term", F.lower("text"))
    tokens = docs.select(F.explode(F.regexp_extract_all("text", F.lit(WORD_TOKEN), F.lit(0))).alias("text"))
    common = written(shaped(tokens).groupBy("term").count().where(f"count > {COMMON}").select("term"), "common_terms")
    rare = shaped(span_ops.found(docs, {"token": WORD_TOKEN})).join(F.broadcast(common) if common.count() <= TERMS_AT_ONCE else common, "term", "left_anti")
    # all tokens of a term that is left are left, so they can be counted here
    counted = rare.withColumn("freq", F.count("*").over(Window.partitionBy("term"))).withColumn("n", F.count("*").over(Window.partitionBy("term", "doc_id")))
    kind = F.when(F.col("freq") >= 3, "valid term").otherwise("proper noun/code")
    kept = counted.where("doc_id is not null and n >= 2 and (freq >= 3 or text rlike '[A-Z]')")
    return kept.select("doc_id", "char_start", "char_end", "text", F.concat(F.lit("repeated "), "n", F.lit("x "), kind).alias("reason"))


@table("merged_issues")
def merged_issues(spark, sf_dir):
    """``merged_sql`` from both kinds of spans: groups are found, judged and merged in one dealing by document."""
    views(spark, sf_dir, grouped(SPARK))
    prio = "CASE source WHEN 'llm' THEN 0 WHEN 'languagetool' THEN 1 ELSE 2 END"
    best = f"SELECT *, first_value(suggestion) OVER (PARTITION BY doc_id, grp ORDER BY {prio}, char_start, ord) AS best FROM ({grouped(SPARK)}) g"
    same = lambda source: f"max(CASE WHEN source = '{source}' AND suggestion = best THEN 1 ELSE 0 END)"
    first = lambda c: f"min_by({c}, struct({prio}, char_start, ord)) AS {c}"
    one = f"SELECT doc_id, grp, {', '.join(map(first, ('char_start', 'char_end', 'text', 'suggestion', 'source', 'issue_type', 'is_protected')))}, count_if(suggestion = best) AS agreement, {same('llm')} AS llm, {same('languagetool')} AS lt, {same('symspell')} AS ss FROM ({best}) w GROUP BY doc_id, grp"
    return spark.sql(judged(SPARK, f"SELECT b.*, b.agreement AS n_agree FROM ({one}) b"))


@plan
def p7_spelling_bypass(d):
    return f"SELECT CASE WHEN issue_type = 'spelling' THEN 'passes' ELSE 'to model' END AS route, count(*) AS n FROM ({candidates(d)}) c GROUP BY CASE WHEN issue_type = 'spelling' THEN 'passes' ELSE 'to model' END"


@plan
def a42_terms_by_category(d):
    return f"SELECT reason, count(DISTINCT lower(text)) AS n_terms, count(*) AS n FROM ({protected(d)}) p GROUP BY reason"


def decided(d) -> str:
    """Issues with the latest decision on each: by document and issue, else by document and position; without one, pending.

    The log: a label of a document is a decision on its first issue, a toxic one a second, later decision; and some rows more.
    """
    more = rows((0, 2, None, "accepted", 1), (0, 2, None, "rejected", 2), (1, None, 0, "accepted", 1), names="doc_id, grp, char_start, status, no")
    labels = "SELECT doc_id, 1 AS grp, CAST(NULL AS BIGINT) AS char_start, CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS status, 1 AS no FROM labels UNION ALL SELECT doc_id, 1, NULL, 'rejected', 2 FROM labels WHERE toxic = 1"
    log = f"SELECT doc_id, grp, char_start, status, no FROM ({labels}) x UNION ALL SELECT doc_id, grp, char_start, status, no FROM {more} m"
    by_id = f"SELECT doc_id, grp, max_by(status, no) AS status FROM ({log}) l WHERE grp IS NOT NULL GROUP BY doc_id, grp"
    by_place = f"SELECT doc_id, char_start, max_by(status, no) AS status FROM ({log}) l WHERE grp IS NULL GROUP BY doc_id, char_start"
    return f"SELECT m.doc_id, m.grp, m.char_start, m.char_end, m.text, m.suggestion, coalesce(i.status, p.status, 'pending') AS decision FROM ({merged(d)}) m LEFT JOIN ({by_id}) i ON m.doc_id = i.doc_id AND m.grp = i.grp LEFT JOIN ({by_place}) p ON m.doc_id = p.doc_id AND m.char_start = p.char_start"


@plan
def j25_decisions(d):
    return f"SELECT doc_id, grp, decision FROM ({decided(d)}) x"
