"""Company comparison: web hits, names, scores, capability matrices. Score tables are fixed values, not measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import matcher
from docspark.operators.ranking import places
from docspark.plans import derived
from docspark.plans.derived import claims, profiles
from docspark.plans.dialect import SPARK, frame, plan, rows, table, views
from docspark.plans.findings import any_of

# Where hits come from that are no companies.
NOISE = (
    "wikipedia.org", "en.wikipedia.org", "medium.com", "wordpress.com", "blogspot.com", "reuters.com", "bloomberg.com", "news.google.com", "cnbc.com", "forbes.com", "linkedin.com", "naukri.com", "glassdoor.com", "indeed.com", "businessinsider.com",
    "crunchbase.com", "pitchbook.com", "youtube.com", "facebook.com", "techcrunch.com", "twitter.com", "x.com", "instagram.com", "reddit.com", "quora.com", "yahoo.com", "scribd.com", "slideshare.net", "github.com", "clutch.co", "g2.com", "capterra.com",
    "trustpilot.com", "goodfirms.co", "upcity.com", "softwareadvice.com", "top50.com", "top10.com", "cbinsights.com", "getlatka.com", "latka.com", "zoominfo.com", "dnb.com", "owler.com", "rocketreach.co", "craft.co", "tracxn.com", "yellowpages.com",
    "persistencemarketresearch.com", "marketresearch.com", "researchandmarkets.com", "grandviewresearch.com", "gartner.com", "forrester.com", "idc.com", "statista.com", "imarcgroup.com", "marketsandmarkets.com", "mordorintelligence.com",
    "fortunebusinessinsights.com", "technavio.com", "verifiedmarketresearch.com", "futuremarketinsights.com", "factmr.com", "constructionworld.in", "reanin.com", "ensun.io", "economictimes.indiatimes.com", "moneycontrol.com", "livemint.com",
)
NOISE_PARTS = ("wikipedia", "naukri", "glassdoor", "indeed", "linkedin", "top50", "clutch", "cbinsights", "latka", "zoominfo", "research")
NOISE_PATHS = ("/blog/", "/blogs/", "/news/", "/article/", "/press-release/", "/press/", "/careers/", "/jobs/", "/job/", "/vacancy/", ".pdf", "/pdf/", "/top-", "/best-", "/list-", "/directory/", "/ranking/", "/comparison/", "/vs/", "/reviews/", "/market-report/", "/industry-report/", "/company-profile/", "/profile/", "epc-companies", "top-10", "top-5")
NO_COMPETITOR = (
    "research", "market research", "reports", "insights", "directory", "profile", "profile page", "corporate website", "news", "times", "journal", "bulletin", "gazette", "wikipedia", "glassdoor", "linkedin", "indeed", "crunchbase", "pitchbook", "zoominfo",
    "dnb", "owler", "tracxn", "yellowpages", "statista", "gartner", "forrester", "idc", "imarc", "mordor", "technavio", "grandview", "company profile pages", "market reports", "research sources", "directories", "businessline", "construction world",
    "future market insights", "factmr", "marketsandmarkets", "epc companies in india", "reanin", "ensun",
)
NAME_STOPS = ("ltd", "inc", "corp", "co", "llc", "epc", "solutions", "limited")
#: Companies that reports are made for; the first is that of the other plans.
TARGETS = ("target", "target works ltd", "works")


def address(d, url: str = "url") -> tuple[str, str]:
    """A hit's domain, without ``www.``, and path, in small letters."""
    low, scheme = f"lower({url})", "^[a-z][a-z0-9+.-]*://"
    return f"replace({d.extract(low, scheme + '([^/?#]*)', 1)}, 'www.', '')", d.extract(low, scheme + "[^/?#]*([^?#]*)", 1)


def noisy(d) -> str:
    domain, path = address(d)
    return f"({d.like('lower(url)', '[.]pdf$')} OR {domain} IN ({', '.join(map(d.text, NOISE))}) OR {any_of(d, domain, NOISE_PARTS)} OR {any_of(d, path, NOISE_PATHS)})"


def no_competitor(d) -> str:
    return f"({any_of(d, 'company', NO_COMPETITOR)} OR {any_of(d, 'domain', NO_COMPETITOR)} OR {any_of(d, 'domain', NOISE)})"


def is_target(d, target: str) -> str:
    """Whether a company is the target: one name holds the other, or their words are the same, or all of the target's two or more."""
    tokens = lambda x: d.minus(d.distinct(d.extract_all(x, "[A-Za-z0-9_]+")), d.array(*map(d.text, NAME_STOPS)))
    t, c = tokens(target), tokens("company")
    subset, equal = f"{d.size(d.minus(t, c))} = 0", f"{d.size(t)} = {d.size(c)}"
    return f"({d.contains('company', target)} OR {d.contains(target, 'company')} OR {d.size(t)} > 0 AND {subset} AND ({equal} OR {d.size(t)} >= 2))"


def hits(d) -> str:
    host = f"regexp_replace(lower({d.extract('url', '^[a-z]+://([^/]+)', 1)}), '^www[.]', '')"
    name = d.sub(d.sub("lower(title)", r"\s*[|].*$", ""), r"(?:^|[^a-z0-9])(?:ltd|pvt|inc|corp|limited|official site|annual report|overview|careers)(?:$|[^a-z0-9])", " ")
    return f"SELECT hit_id, title, url, score, {host} AS domain, trim({d.sub(name, '[^a-z0-9 ]', '')}) AS company FROM {derived.hits(d)} h"


def useful(d) -> str:
    """Hits of companies that aren't the target; keywords by the matcher here, by ``contains`` in the check."""
    whole = lambda d: f"SELECT * FROM ({hits(d)}) x WHERE NOT {noisy(d)} AND NOT {no_competitor(d)} AND NOT {is_target(d, d.text(TARGETS[0]))}"
    return d.stored("useful_hits", whole)


@table("useful_hits")
def useful_hits(spark, sf_dir):
    return _competitors(_no_noise(_hit_rows(spark, sf_dir))).where(f"NOT {is_target(SPARK, SPARK.text(TARGETS[0]))}")


def grouped(d) -> str:
    return f"SELECT domain, min(company) AS company, count(*) AS n_hits, count(DISTINCT url) AS n_urls, max(score) AS best FROM ({useful(d)}) u GROUP BY domain"


def scores(d) -> str:
    conf = "least(CAST(1 AS DOUBLE), 0.60 + n_hits * 0.10 + best * 0.30)"
    return f"SELECT *, round({conf} * 0.25 + CASE WHEN n_hits >= 2 THEN 0.85 ELSE 0.70 END * 0.25 + 0.80 * 0.20 + 0.75 * 0.15 + 0.80 * 0.15, 6) * CAST(1 AS DOUBLE) AS composite FROM ({grouped(d)}) g"


@plan
def f16_company_names(d):
    return f"SELECT hit_id, company FROM ({hits(d)}) h"


def _hit_rows(spark, sf_dir):
    sql = f"SELECT * FROM ({hits(SPARK)}) h"
    views(spark, sf_dir, sql)
    return spark.sql(sql)


def _no_noise(own):
    """Hits that aren't from directories, news or reports, by what their domains and paths hold; keywords are looked for in one pass."""
    domain, path = (F.expr(x) for x in address(SPARK))
    some = matcher.tagged(matcher.tagged(own.withColumns({"_of": domain, "_at": path}), "_of", {"part": NOISE_PARTS}, "_parts"), "_at", {"path": NOISE_PATHS}, "_paths")
    noise = F.lower("url").endswith(".pdf") | F.col("_of").isin(*NOISE) | (F.size("_parts") > 0) | (F.size("_paths") > 0)
    return some.where(~noise).select(own.columns)


def _competitors(own):
    """Hits that aren't named like reports, directories or papers, nor lie on their domains."""
    some = own.withColumn("_both", F.concat_ws("\n", "company", "domain"))
    some = matcher.tagged(matcher.tagged(some, "_both", {"name": NO_COMPETITOR}, "_names"), "domain", {"noise": NOISE}, "_noise")
    return some.where((F.size("_names") == 0) & (F.size("_noise") == 0)).select(own.columns)


@frame(lambda d: f"SELECT hit_id, domain FROM ({hits(d)}) h WHERE NOT {noisy(d)}")
def p12_noise_filter(spark, sf_dir):
    return _no_noise(_hit_rows(spark, sf_dir)).select("hit_id", "domain")


@frame(lambda d: f"SELECT hit_id FROM ({hits(d)}) h WHERE NOT {no_competitor(d)}")
def p13_entity_filter(spark, sf_dir):
    return _competitors(_hit_rows(spark, sf_dir)).select("hit_id")


@plan
def p14_target_exclusion(d):
    """For each target the hits of other companies."""
    each = " UNION ALL ".join(f"SELECT {d.text(t)} AS target, hit_id FROM ({hits(d)}) h WHERE NOT {is_target(d, d.text(t))}" for t in TARGETS)
    return f"SELECT target, hit_id FROM ({each}) e"


@plan
def u6_distinct_urls(d):
    return f"SELECT url, min(hit_id) AS hit_id FROM ({hits(d)}) h GROUP BY url"


@plan
def a27_competitor_groups(d):
    return grouped(d)


@plan
def f50_composite_scores(d):
    return f"SELECT domain, composite FROM ({scores(d)}) s"


@plan
def a28_above_threshold(d):
    return f"SELECT domain FROM ({scores(d)}) s WHERE composite >= 0.65"


@plan
def o12_top_competitors(d):
    five = f"SELECT domain, composite FROM ({scores(d)}) s ORDER BY composite DESC, domain LIMIT 5"
    return f"SELECT domain, CAST(row_number() OVER (ORDER BY composite DESC, domain) AS INT) AS place FROM ({five}) t"


@plan
def j23_new_urls(d):
    more = f"(SELECT hit_id, url FROM {rows((8, 'https://bolt.io/'), (9, 'https://new.io/x'), names='hit_id, url')} v UNION ALL SELECT page_id, {d.sub('url', '[?].*$', '')} FROM pages)"
    return f"SELECT m.hit_id, m.url FROM {more} m LEFT JOIN {derived.hits(d)} h ON m.url = h.url WHERE h.url IS NULL"


@plan
def j24_comparison(d):
    """Target against competitors by attribute, in long form."""
    return f"SELECT c.company, c.attribute, count(t.value) AS shared, count(*) AS own FROM {profiles(d)} c LEFT JOIN {profiles(d)} t ON t.company = 'Target' AND t.attribute = c.attribute AND t.value = c.value WHERE c.company <> 'Target' GROUP BY c.company, c.attribute"


@plan
def a32_peer_union(d):
    return f"SELECT attribute, {d.strings('value', ', ', 'value')} AS all_values FROM (SELECT DISTINCT attribute, value FROM {profiles(d)} p WHERE company <> 'Target') u GROUP BY attribute"


def counts(d, words: tuple[str, ...], text: str = "low") -> str:
    """How often words stand in a text, added up."""
    return "(" + " + ".join(f"(length({text}) - length(replace({text}, {d.text(w)}, ''))) / {len(w)}" for w in words) + ")"


# Words by industry, in the order that breaks ties, and the two sides of the profile correction.
INDUSTRIES = (
    ("Engineering Procurement & Construction (EPC)", ("epc", "engineering", "procurement", "construction", "bulk material handling", "ash handling", "material handling", "heavy engineering", "turnkey project", "power plant", "steel plant", "cement plant", "infrastructure", "btl epc", "btl")),
    ("Manufacturing & Industrial", ("manufacturing", "industrial", "factory", "equipment", "machinery", "fabrication", "assembly", "automation", "plant")),
    ("Energy & Utilities", ("energy", "renewable", "solar", "wind", "power generation", "utilities", "oil & gas", "refinery")),
    ("AI & Document Intelligence", ("document intelligence", "ocr", "nlp", "llm", "ai proofread", "text extraction", "artificial intelligence")),
    ("Software & Cloud Solutions", ("saas", "cloud platform", "cloud software", "cybersecurity", "devops", "software product")),
    ("Healthcare & Life Sciences", ("healthcare", "medical", "pharmaceutical", "clinical", "biotech", "hospital")),
    ("Financial Services & Banking", ("financial", "banking", "fintech", "investment", "insurance", "capital markets")),
)
EPC_WORDS = ("epc", "engineering", "procurement", "construction", "material handling", "ash handling", "heavy engineering", "turnkey", "infrastructure", "plant", "steel", "btl")
SOFTWARE_WORDS = ("saas", "cloud platform", "devops", "software product", "app development", "cybersecurity")
COMPANIES = rows((-1, "EPC contractor: engineering, procurement and construction of power plant and steel plant, turnkey plant infrastructure"), (-2, "SaaS and cloud platform with cybersecurity, plant API"), (-3, "Clinical software for any hospital"), (-4, None), names="doc_id, text")


def voted(d) -> str:
    every = f"SELECT doc_id, lower(coalesce(text, '')) AS low FROM (SELECT doc_id, text FROM {COMPANIES} c UNION ALL SELECT doc_id, text FROM documents) x"
    votes = ", ".join(f"{d.int(f'round({counts(d, words)})')} AS v{i}" for i, (_, words) in enumerate(INDUSTRIES))
    best = f"greatest({', '.join(f'v{i}' for i in range(len(INDUSTRIES)))})"
    name = " ".join(f"WHEN v{i} = {best} THEN {d.text(n)}" for i, (n, _) in enumerate(INDUSTRIES))
    return f"SELECT doc_id, low, {best} AS votes, CASE {name} END AS industry FROM (SELECT doc_id, low, {votes} FROM ({every}) e) v"


@plan
def a29_industry_vote(d):
    """Keyword votes for an industry over whole documents; ties and documents without a vote to the first listed."""
    return f"SELECT doc_id, votes, industry FROM ({voted(d)}) v"


@plan
def a30_profile_correction(d):
    """A software or document industry gives way where the words of plant building are many, and over twice the others'."""
    n = f"SELECT doc_id, industry, {d.int(f'round({counts(d, EPC_WORDS)})')} AS epc, {d.int(f'round({counts(d, SOFTWARE_WORDS)})')} AS software FROM ({voted(d)}) v"
    wrong = " OR ".join(d.contains("lower(industry)", d.text(w)) for w in ("software", "cloud", "ai & document", "saas", "not specified"))
    return f"SELECT doc_id, CASE WHEN epc > 5 AND epc > 2 * software AND ({wrong}) THEN {d.text(INDUSTRIES[0][0])} ELSE industry END AS industry FROM ({n}) x"


@plan
def a31_owner_vote(d):
    """Whose report a host's pages are: 40 for each time its name stands in a title, 50 more on the first page; 70 and above."""
    pages_ = f"SELECT hit_id, title, {d.extract('url', '^[a-z]+://(?:www[.])?([^./]+)', 1)} AS company FROM {derived.hits(d)} h"
    cover = f"SELECT *, row_number() OVER (PARTITION BY company ORDER BY hit_id) = 1 AS is_cover FROM ({pages_}) p WHERE company <> ''"
    n = "(length(title) - length(replace(lower(title), lower(company), ''))) / length(company)"
    votes = f"SELECT company, {d.int(f'sum(floor(40 * {n}) + CASE WHEN is_cover AND {n} > 0 THEN 50 ELSE 0 END)')} AS votes FROM ({cover}) c GROUP BY company"
    return f"SELECT company, votes FROM ({votes}) v WHERE votes >= 70"


@plan
def p22_sanitised_items(d):
    own = f"(SELECT company, item FROM {rows((-1, 'Fast delivery'), (-1, 'fast delivery'), (-1, 'as an AI model'), (-2, 'Lorem ipsum'), names='company, item')} v UNION ALL SELECT doc_id, text FROM {claims(d)} c)"
    return f"SELECT company, min(item) AS item FROM {own} o WHERE NOT {d.like('lower(item)', 'as an ai|lorem ipsum')} GROUP BY company, lower(item)"


@plan
def p32_recommendations(d):
    """Five recommendations of a document at most, the first two of high priority; none if there are fewer than three."""
    from docspark.plans.findings import RANK, scored

    ranked = f"SELECT doc_id, coalesce(nullif(explanation, ''), title) AS title, row_number() OVER (PARTITION BY doc_id ORDER BY {RANK}, risk_score DESC, finding_id) AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM ({scored(d)}) s WHERE rejection IS NULL"
    return f"SELECT doc_id, {d.int('place')} AS place, title, CASE WHEN place <= 2 THEN 'High' ELSE 'Medium' END AS priority FROM ({ranked}) r WHERE n >= 3 AND place <= 5"


@frame(lambda d: f"SELECT company, {d.int('90 - 5 * (row_number() OVER (ORDER BY company) - 1)')} AS score FROM (SELECT DISTINCT company FROM {profiles(d)} p) c")
def f51_position_scores(spark, sf_dir):
    sql = f"SELECT DISTINCT company FROM {profiles(SPARK)} p"
    views(spark, sf_dir, sql)
    return places(spark.sql(sql), "_place", F.col("company")).select("company", (90 - 5 * (F.col("_place") - 1)).alias("score"))
