"""Text functions as column expressions; patterns keep to what Java and RE2 both read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null for none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case host without www. and port; empty for none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1)), r"^www\.", "")


def normalize_arxiv(raw: Column) -> Column:
    """a.b of an arXiv id in any form: case, slashes and version dropped, _ read as a dot; null for none."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(raw), "/", ""), r"v[0-9]+$", "")
    return F.regexp_replace(found(plain, r"[0-9]{4}[._][0-9]{4,6}"), "_", ".")


def anchored_id(raw: Column) -> Column:
    """A bare arXiv id without its version, or a DOI in lower case; null for anything else."""
    text = F.trim(raw)
    arxiv = found(text, r"^(?:[aA][rR][xX][iI][vV]:)?([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?$", 1)
    doi = F.lower(found(text, r"^(?:https?://(?:dx\.)?doi\.org/|doi:)?(10\.[0-9]{4,9}/[^ ]+)$", 1))
    return F.coalesce(arxiv, doi)


def extract_arxiv(text: Column) -> Column:
    """The id in an arXiv URL, else one that ends the text."""
    return F.coalesce(found(text, r"arxiv\.org/(?:abs|pdf|html)/([0-9]{4}\.[0-9]{4,6})", 1), found(text, r"(?:^|[^0-9.])([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?$", 1))


def extract_doi(text: Column) -> Column:
    """From a doi.org URL, a `doi:` label or bare, in this order, without closing punctuation."""
    raw = F.coalesce(found(text, r"doi\.org/(10\.[0-9]{4,9}/[^ \n<>\"]+)", 1), found(text, r"[dD][oO][iI]:? *(10\.[0-9]{4,9}/[^ \n<>\"]+)", 1), found(text, r"(?:^|[ \n])(10\.[0-9]{4,9}/[^ \n<>\"]+)", 1))
    return F.regexp_replace(raw, r"[.,;:)!?\]}]+$", "")


def canonical_url(url: Column) -> Column:
    """One form of a URL: arXiv, SSRN and DOI addresses by their id; else host and path without query, fragment and closing slash.

    Of a ResearchGate publication the number and the lower-cased title stay.
    """
    arxiv = found(url, r"(?i)arxiv\.org/(?:abs|pdf|html)/([0-9]{4}\.[0-9]{4,6})", 1)
    ssrn = F.coalesce(found(url, r"(?i)ssrn\.com/.*abstract_id=([0-9]+)", 1), found(url, r"(?i)ssrn\.com/abstract=([0-9]+)", 1))
    doi = found(url, r"(?i)doi\.org/(10\.[^?#]+)", 1)
    scheme, name, path = (F.regexp_extract(url, r"^([a-zA-Z]+)://([^/?#]*)([^?#]*)", i) for i in (1, 2, 3))
    path = F.regexp_replace(path, "/+$", "")
    publication = F.when(F.contains(F.lower(name), F.lit("researchgate.net")), F.lower(found(path, "^(/publication/[0-9]+_[^/]+)", 1)))
    plain = F.concat(F.lower(scheme), F.lit("://"), F.lower(name), F.coalesce(publication, F.when(path == "", "/").otherwise(path)))
    return (
        F.when(arxiv.isNotNull(), F.concat(F.lit("arxiv.org/abs/"), arxiv)).when(ssrn.isNotNull(), F.concat(F.lit("https://ssrn.com/abstract="), ssrn))
        .when(doi.isNotNull(), F.concat(F.lit("https://doi.org/"), F.lower(doi))).when(scheme == "", "").otherwise(plain)
    )


def slug(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(plain == "", "untitled").otherwise(F.substring(plain, 1, 60))


# Names of files that say nothing
GENERIC = ("source.pdf", "pdf.txt", "web.txt", "content_list.json")


def norm_source(path: Column) -> Column:
    """The file's name, or its folder's if the name is generic; without .txt."""
    parts = F.split(path, "/")
    leaf = F.element_at(parts, -1)
    name = F.when(leaf.isin(*GENERIC) & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2))).otherwise(leaf)
    return F.regexp_replace(name, r"\.txt$", "")


def canonical_id(arxiv: Column, doi: Column, url: Column, title: Column, author: Column) -> Column:
    """struct(id, id_type) by arXiv id, DOI, URL, or a hash of title and first author."""
    some = lambda c: F.nullif(c, F.lit(""))
    hashed = F.substring(F.sha2(F.concat_ws("/", title, author), 256), 1, 16)
    kind = F.when(some(arxiv).isNotNull(), "arxiv").when(some(doi).isNotNull(), "doi").when(some(url).isNotNull(), "url").otherwise("title")
    return F.struct(F.coalesce(some(arxiv), F.lower(some(doi)), some(url), hashed).alias("id"), kind.alias("id_type"))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " "))


def exact_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def soft_hash(text: Column) -> Column:
    """Of the first 2048 characters in lower case with white space collapsed."""
    return exact_hash(F.substring(collapsed(text), 1, 2048))


def truncate_utf8(text: Column, limit: int) -> Column:
    """The longest prefix of at most limit bytes of UTF-8, whole characters only.

    Bytes 0x80 to 0xBF continue a character: the cut moves back over at most three of them.
    """
    data = F.encode(text, "UTF-8")
    cut = F.substring(F.hex(F.substring(data, 1, limit + 1)), 1, 2 * limit + 2)
    continues = lambda i: F.substring(cut, 2 * i + 1, 1).isin("8", "9", "A", "B")  # noqa: E731  byte i, from 0
    keep = F.lit(limit)
    for back in (3, 2, 1, 0):
        keep = F.when(~continues(limit - back), limit - back).otherwise(keep) if back else F.when(~continues(limit), limit).otherwise(keep)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(data, F.lit(1), keep), "UTF-8"))


def cap_text(text: Column, limit: int = 4096, keep: int = 4090) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit(" …"))).otherwise(text)


# What pages say that are not the wanted page, in the first 1500 characters, lower case
FAIL_SIGNS = (
    "just a moment", "performing security verification", "enable javascript and cookies to continue", "privacy and security by cloudflare", "ray id:", "checking your browser",
    "ddos protection by cloudflare", "this website uses a security service to protect", "verifying you are human", "sicherheitsüberprüfung wird durchgeführt",
    "diese website nutzt einen sicherheitsservice", "überprüfung erfolgreich", "vérification de sécurité", "vous êtes un humain", "comprobando que eres humano", "verificación de seguridad",
    "access denied", "this site can", "404 not found", "403 forbidden", "401 unauthorized", "page not found", "are you a robot", "captcha", "before you continue to google",
    "we'll remember this choice", "marketchameleon", "possible reasons for receiving this error", "error 1020", "using a vpn or other security product",
)

# Patterns of pages without content, by name, case-insensitive and by line, in the first 2000 characters
GARBAGE = (
    (r"access\s+denied", "access_denied"), (r"\b(cloudflare|cf-ray|ray\s*id)\b", "cloudflare"), (r"error\s+(1020|1015|1010|403|404|503|429)", "error_code"), (r"site\s+owner.*restrictions", "owner_block"),
    (r"are\s+you\s+a\s+(robot|human)", "captcha"), (r"verify\s+(you|that)\s+(are|you)", "captcha2"), (r"this\s+(page|site|content)\s+(is\s+)?(not|no\s+longer)\s+available", "unavailable"),
    (r"temporarily\s+unavailable", "temp_unavail"), (r"^\s*you\s+do\s+not\s+have\s+access", "no_access"), (r"checking\s+your\s+browser", "ddos_check"), (r"just\s+a\s+moment\.\.\.", "just_moment"),
    (r"page\s+not\s+found", "page_not_found"), (r"oops[!,.]?\s+(this\s+page|we\s+couldn't|the\s+page)", "oops_404"), (r"incapsula\s+incident\s+id", "incapsula"), (r"\bopenresty\b", "openresty_block"),
    (r"verification\s+required", "verification_required"), (r"verifying\.\.\.", "cf_verifying"), (r"\baltcha\b", "altcha_captcha"), (r"request\s+unsuccessful", "request_unsuccessful"),
    (r"the\s+page\s+you('re|\s+are)\s+looking\s+for", "page_lookup"), (r"sorry[!,.\s]+the\s+page", "sorry_page"),
)


def longest_line(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(text, "\n"), lambda x: F.length(F.trim(x)))), F.lit(0))


def longest_paragraph(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(text, "\n\n"), lambda x: F.length(F.trim(x)))), F.lit(0))


def fail_signature(text: Column) -> Column:
    """The first sign in the first 1500 characters, else no_prose if no line has 70 characters; null for a good page."""

    def sign_of(head: Column) -> Column:
        sign = F.when(longest_line(text) < 70, "no_prose")
        for literal in reversed(FAIL_SIGNS):
            sign = F.when(head.contains(literal), literal).otherwise(sign)
        return sign

    # the head is made once, as a variable, and not for each sign
    return F.transform(F.array(F.lower(F.substring(text, 1, 1500))), sign_of)[0]


def quality_score(text: Column) -> Column:
    n = F.length(text)
    return F.when(fail_signature(text).isNull() & (n >= 400), 10000 + n).otherwise(n)


NOISE_LINE = "^(https?://[^ \t]*|[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12})$"


def garbage_reason(text: Column) -> Column:
    """too_small below 1000 characters, a pattern's name, low_signal_after_strip if under 800 stay without lines of URLs and UUIDs; null for a good text."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.regexp_like(F.trim(x), F.lit(NOISE_LINE)))
    reason = F.when(F.length(F.trim(F.array_join(lines, "\n"))) < 800, "low_signal_after_strip")
    for pattern, name in reversed(GARBAGE):
        reason = F.when(F.regexp_like(F.substring(text, 1, 2000), F.lit("(?im)" + pattern)), name).otherwise(reason)
    return F.when(F.length(text) < 1000, "too_small").otherwise(reason)


# Lines of a table of contents
TOC_DOTTED, TOC_NUMBERED = r"\.{3,}\s*\d+\s*$", r"^\d+(\.\d+)*\s+\S.*\s+\d+\s*$"


def looks_like_toc(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n = F.size(lines)
    dotted = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(TOC_DOTTED))))
    numbered = F.size(F.filter(lines, lambda x: F.regexp_like(F.trim(x), F.lit(TOC_NUMBERED))))
    return (n >= 5) & ((dotted >= 0.4 * n) | (numbered >= 0.6 * n))


# What lines of navigation say, lower case
NAV_PHRASES = (
    "skip to main content", "skip navigation", "skip to content", "subscribe", "sign in", "log in", "sign up", "log out", "privacy policy", "terms of service", "terms of use", "cookie policy",
    "cookies preferences", "menu", "share", "tweet", "facebook", "linkedin", "copy link", "buy crypto", "free trial", "download", "get started", "back to top", "view all", "see all", "load more",
    "show more", "show less", "read more", "click here", "bearbeiten", "quelltext bearbeiten", "bearbeiten | quelltext bearbeiten", "edit", "edit source", "view source", "talk", "published:",
    "last updated:", "reading time:", "min read", "written by", "posted on", "originally published", "originally posted", "this article was", "disclaimer:", "disclaimer", "all rights reserved",
    "copyright ©",
)
# Lines without words (a bare URL, marks, symbols) and what wiki pages put before a paragraph
NAV_LINE = r"^(?:https?://\S+|[^\p{L}\p{N}_]{0,4}|[☰-⛿✀-➿←-⇿]+)$"
WIKI_EDIT = r"(?i)^\[(?:bearbeiten|edit|editar)(?:\s*\|\s*(?:quelltext|source|fuente)\s*(?:bearbeiten|edit|editar))?\]"
NAV_INSIDE = "|".join(x.replace("|", r"\|") for x in NAV_PHRASES)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
EDGES = r"^[\s\x0b]+|[\s\x0b]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def once(x: Column, f) -> Column:
    """f(x) with x computed once: Spark doesn't share the parts of an expression inside a lambda function."""
    return F.transform(F.array(x), f)[0]


def is_nav(line: Column) -> Column:
    """Whether a line that isn't blank is a phrase of navigation, contains one within 40 characters, or has no words."""

    def judged(t: Column) -> Column:
        low, n = F.lower(t), F.length(t)
        return (n > 0) & (low.isin(*NAV_PHRASES) | F.regexp_like(t, F.lit(NAV_LINE)) | ((n <= 40) & F.regexp_like(low, F.lit(NAV_INSIDE))))

    return once(stripped(line), judged)


def clean_nav(text: Column) -> Column:
    """Without navigation lines and wiki edit links; a first line that # begins stays; runs of blank lines become one; a line end closes."""

    def line(x: Column, i: Column) -> Column:
        plain = once(F.regexp_replace(x, WIKI_EDIT, ""), lambda p: F.when(~is_nav(p), p))
        return F.when((i == 0) & F.regexp_like(x, F.lit("^[\\s]*#")), x).otherwise(plain)

    kept = F.array_join(F.filter(F.transform(F.split(text, LINE_END), line), lambda x: x.isNotNull()), "\n")
    return F.when(text == "", text).otherwise(F.concat(stripped(F.regexp_replace(kept, "\n{3,}", "\n\n")), F.lit("\n")))


# How lines begin behind which an article has ended
TAIL_SIGNS = (
    r"related\s+articles?\b", r"related\s+reading\b", r"related\s+posts?\b", r"related\s+stories\b", r"you\s+may\s+(also\s+)?like\b", r"subscribe\s+(to|for)\b", r"stay\s+up[- ]to[- ]date\b",
    r"sign\s+up\s+(for|to)\s+(our\s+)?newsletter\b", r"join\s+our\s+newsletter\b", r"no\s+comments?\s+yet\b", r"post\s+a\s+comment\b", r"leave\s+a\s+(reply|comment)\b",
    r"share\s+this\s+(article|post|story)\b", r"about\s+the\s+author\b", r"©\s*\d{4}", r"all\s+rights\s+reserved\b",
)
TAIL = r"(?is)^(.*?)(?:\n|^)(?:" + "|".join(TAIL_SIGNS) + ")"


def tail_strip(text: Column) -> Column:
    """Cut before the first line that a tail sign begins, if at least 80 % stays; a line end closes a cut text."""
    head = F.regexp_extract(text, TAIL, 1)
    cut = F.regexp_like(text, F.lit(TAIL)) & (F.length(head) >= F.floor(F.lit(0.8) * F.length(text)))
    return F.when(cut & (text != ""), F.concat(F.regexp_replace(head, r"[\s\x0b]+$", ""), F.lit("\n"))).otherwise(text)


# Names of sections behind a paper's content
TAIL_SECTIONS = (
    r"(?:references|bibliography|works\s+cited|citations?|cited\s+by|acknowledg(?:e?ment)?s?|funding|author\s+contributions?|conflicts?\s+of\s+interest|competing\s+interests?|data\s+availability"
    r"|supplementary(?:\s+(?:material|information))?|appendix\s*[A-Z0-9]?)"
)
_TO_LINE_END = r"[ \t]*:?[ \t\r\f]*(?:\n|$)"
HARD_SECTION = rf"(?is)^(.*?)(?:\n|^)[ \t]*#{{1,4}}[ \t]+{TAIL_SECTIONS}{_TO_LINE_END}"
SOFT_SECTION = rf"(?is)^(.*?)\n[ \t]*{TAIL_SECTIONS}{_TO_LINE_END}"


def strip_sections(text: Column) -> Column:
    """Cut before the first Markdown heading of a tail section, else before the first bare line of one behind 20 % of the text."""
    before = F.greatest(F.floor(F.lit(0.2) * F.length(text)).cast("int") - 1, F.lit(0))
    rest = F.substring(text, before + 1, F.length(text))
    end = lambda x: F.regexp_replace(x, r"[\s\x0b]+$", "")
    soft = F.when(F.regexp_like(rest, F.lit(SOFT_SECTION)), end(F.concat(F.substring(text, F.lit(1), before), F.regexp_extract(rest, SOFT_SECTION, 1))))
    return F.when(F.regexp_like(text, F.lit(HARD_SECTION)), end(F.regexp_extract(text, HARD_SECTION, 1))).otherwise(F.coalesce(soft, text))


# Words that say nothing about a file's content, and words that are no content nouns
STOP_WORDS = (
    "and", "the", "for", "with", "from", "into", "onto", "what", "when", "where", "how", "why", "this", "that", "these", "those", "have", "has", "had", "are", "was", "were", "been",
    "being", "will", "would", "could", "should", "your", "you", "use", "uses", "using", "used", "via", "but", "not", "all", "any", "can", "may", "might", "more", "most", "much", "some",
    "such", "than", "then", "they", "them", "their", "there", "here", "about", "between", "across", "above", "below", "after", "before", "during", "since", "until", "while", "also", "yet",
    "out", "off", "com", "org", "net", "io", "wiki", "wikipedia", "github", "reddit", "papers", "arxiv", "pdf", "html", "edu", "blog", "post", "page", "site", "review", "guide", "intro",
    "introduction", "based", "vol", "ssrn", "doi",
)
NOUN_STOP_WORDS = (
    "the", "is", "at", "which", "on", "in", "a", "an", "and", "or", "but", "not", "to", "of", "for", "with", "from", "by", "about", "as", "into", "through", "during", "before", "after",
    "above", "below", "between", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "both", "each", "few", "more",
    "most", "other", "some", "such", "than", "that", "this", "what", "these", "those", "can", "will", "just", "should", "now", "also", "has", "have", "are", "was", "were", "been", "does",
    "its", "much", "very",
)


def descriptive_tokens(name: Column) -> Column:
    """Distinct runs of four or more letters and digits of a path's file name, without its NNN__ prefix, ending and stop words; none for names of URLs."""
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.lower(name), "/"), -1), r"\.[a-z0-9]{1,5}$", ""), r"^[0-9]+__", "")
    words = F.filter(F.regexp_extract_all(stem, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS))
    return F.when(F.regexp_like(stem, F.lit("^https?[_-]")), F.array().cast("array<string>")).otherwise(F.array_distinct(words))


def overlap_ratio(tokens: Column, text: Column) -> Column:
    """The share of tokens that the text contains; 1 for no tokens."""
    # the text in lower case is made once, as a variable, and not for each token
    held = F.transform(F.array(F.lower(text)), lambda t: F.size(F.filter(tokens, lambda w: F.contains(t, w))))[0]
    return F.when(F.size(tokens) == 0, 1.0).otherwise(held / F.size(tokens))


def content_nouns(text: Column, most: int = 8) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*NOUN_STOP_WORDS))), 1, most)


def strip_latex(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\[a-zA-Z]+\{([^{}]*)\}", "$1"), r"\$([^$]*)\$", "$1")


#: [n] or [n, m] behind no letter, digit or underscore
NUMBERED = r"(?<![A-Za-z0-9_])\[((?:\d+\s*,\s*)*\d+)\]"


def cited_numbers(text: Column) -> Column:
    """Numbers in [n] and [n, m], every time they stand, in order."""
    groups = F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(1))
    return F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda n: n.try_cast("int"))


def cited_indices(text: Column) -> Column:
    """Numbers in [n] and [n, m] that no letter, digit or underscore precedes, first occurrences in order."""
    return F.array_distinct(cited_numbers(text))


def cited_files(text: Column) -> Column:
    """(file, page) of the tokens file:page and file:image in brackets, in order; page is null for an image."""
    blocks = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    token = r"([^\s,\[\]]+):(image|\d+)"
    tokens = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(token), F.lit(0))))
    return F.transform(tokens, lambda t: F.struct(F.regexp_extract(t, token, 1).alias("file"), F.regexp_extract(t, token, 2).try_cast("int").alias("page")))


def strip_sources(answer: Column) -> Column:
    """Without the last block that a line `Sources:` or `References:` begins."""
    return F.regexp_replace(answer, r"(?s)^(.*)\n(?:Sources|References):.*$", "$1")


# Words of affiliations and of pages' furniture, and phrases that begin navigation
AFFILIATIONS = (
    "Department", "University", "School of", "Institute", "Laboratory", "Faculty", "College", "Center", "Centre", "Corporation", "Foundation",
    "Abstract", "Keywords", "JEL", "Received", "Forthcoming", "Initial Version", "First version", "Current version", "This version",
    "Login", "Password", "Sign in", "Sign up", "Register", "Subscribe", "Cookie", "Privacy", "Terms of Use", "Terms of Service", "Copyright",
    "Returning user", "Forgot", "Username", "Account",
)
NAVIGATION = (
    "jump to", "skip to", "click here", "learn more", "get started", "read more", "sign in", "sign up", "log in", "log out", "subscribe",
    "contact us", "about us", "home", "menu", "search",
)
LETTER = r"\p{L}\p{N}_"
NO_AUTHORS = (
    rf"(?i)(?:^|[^{LETTER}])(?:{'|'.join(AFFILIATIONS)})(?:$|[^{LETTER}])",
    rf"[{LETTER}.+-]+@[{LETTER}-]+\.[{LETTER}.-]+",  # an address
    r"^[0-9\s,./-]+$",
    r"\|",
    r" [-—] [A-Z][a-zA-Z0-9]{2,}$",  # a page's title with a brand behind it
    rf"(?i)^(?:{'|'.join(NAVIGATION)})(?:$|[^{LETTER}])",
    r"[←-⇿➠-➿»]$",
    r"^\p{S}",
)


def author_line(line: Column) -> Column:
    """Whether a line may list authors: 4 to 400 characters, two words or more, one capitalised, and nothing of a page's furniture.

    A line of 30 characters or more with a colon before any comma is a headline.
    """
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    good = F.length(t).between(4, 400) & F.contains(t, F.lit(" ")) & F.regexp_like(t, F.lit(rf"(?:^|[^{LETTER}])[A-Z][a-zA-Z]"))
    for pattern in NO_AUTHORS:
        good = good & ~F.regexp_like(t, F.lit(pattern))
    return good & ~((F.length(t) >= 30) & F.regexp_like(t, F.lit("^[^,]*:")))


def split_authors(line: Column) -> Column:
    """Names of a list by commas, semicolons and `and`, without footnote marks and digits."""
    plain = line
    for _ in range(3):
        plain = F.regexp_replace(plain, r"[*†‡§0-9]+( |,|;|$)", "$1")
    return F.filter(F.transform(F.split(F.regexp_replace(plain, " and ", ","), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


# Particles of surnames
PARTICLES = ("van", "von", "de", "der", "den", "la", "di", "da")


def last_name(author: Column) -> Column:
    """The surname with its particles."""
    words = F.split(F.trim(author), " +")
    last = F.element_at(words, -1)
    before = F.try_element_at(words, F.lit(-2))
    further = F.try_element_at(words, F.lit(-3))
    one, two = F.lower(before).isin(*PARTICLES), F.lower(further).isin(*PARTICLES)
    return F.when(one & two, F.concat_ws(" ", further, before, last)).when(one, F.concat_ws(" ", before, last)).otherwise(last)


def short_cite(names: Column, year: Column) -> Column:
    """A 2020, A & B 2020, A et al. 2020; null without authors."""
    n = F.size(names)
    first, second = F.try_element_at(names, F.lit(1)), F.try_element_at(names, F.lit(2))
    who = F.when(n == 1, first).when(n == 2, F.concat(first, F.lit(" & "), second)).when(n > 2, F.concat(first, F.lit(" et al.")))
    return F.when(year.isNull(), who).otherwise(F.concat(who, F.lit(" "), year.cast("string")))


def extract_year(url: Column, text: Column) -> Column:
    """From an arXiv id in the URL, else `Month YYYY`, else the most common year of 1980 to 2030 in the first 800 characters, the first on ties."""
    arxiv = found(url, r"arxiv\.org/(?:abs|pdf)/([0-9]{2})[0-9]{2}\.", 1).cast("int") + 2000
    month = found(text, r"(?:January|February|March|April|May|June|July|August|September|October|November|December) ((?:19|20)[0-9]{2})", 1).cast("int")
    years = F.filter(F.transform(F.regexp_extract_all(F.substring(text, 1, 800), F.lit("[0-9]+"), F.lit(0)), lambda y: F.when(F.length(y) == 4, y.cast("int"))), lambda y: y.between(1980, 2030))
    ranked = F.array_max(F.transform(F.array_distinct(years), lambda y: F.struct(F.size(F.filter(years, lambda z: z == y)).alias("n"), (-F.array_position(years, y)).alias("first"), y.alias("year"))))
    return F.coalesce(arxiv, month, ranked["year"])


# Hosts that are cited as a whole, with the attribution and the brand of each
PLATFORMS = (
    ("wikipedia.org", "Wikipedia contributors", "Wikipedia"),
    ("wikimedia.org", "Wikipedia contributors", "Wikipedia"),
    ("reddit.com", "Reddit", "Reddit"),
    ("news.ycombinator.com", "Hacker News", "Hacker News"),
    ("stackoverflow.com", "Stack Overflow", "Stack Overflow"),
    ("stackexchange.com", "Stack Exchange", "Stack Exchange"),
)


def platform_match(url: Column) -> Column:
    """struct(attribution, brand) of a URL on one of the platforms' hosts or below; null elsewhere."""
    h = host(url)
    pair = F.lit(None).cast("struct<attribution:string,brand:string>")
    for name, attribution, brand in reversed(PLATFORMS):
        pair = F.when((h == name) | h.endswith("." + name), F.struct(F.lit(attribution).alias("attribution"), F.lit(brand).alias("brand"))).otherwise(pair)
    return pair


# Words of dates, of pages that block readers and of prose; brands' own spelling
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "mon", "tue", "wed", "thu", "fri", "sat", "sun")
BLOCKERS = ("cloudflare", "recaptcha", "captcha", "datadome", "perimeterx", "imperva", "akamai", "incapsula")
FUNCTION_WORDS = ("the", "of", "with", "in", "on", "for", "by", "as", "an", "a", "and", "or", "to", "at", "from", "via", "per", "into", "onto", "upon")
BRANDS = ("GitHub", "MDPI", "ResearchGate", "arXiv", "PMC", "QuantStart", "IDEAS/RePEc", "SSRN", "Papers with Code")


def brand(name: Column) -> Column:
    """A known brand in its own spelling, other names as they are."""
    known = F.create_map(*(F.lit(x) for b in BRANDS for x in (b.lower(), b)))
    return F.coalesce(known[F.lower(name)], name)


def valid_site_name(name: Column) -> Column:
    """The name, or null for dates, blocked pages, sentences, more than four words, capitals throughout and two words of prose or more."""
    t = F.regexp_replace(name, r"^\s+|\s+$", "")
    tokens = F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0))
    bad = F.exists(tokens, lambda w: w.isin(*MONTHS, *WEEKDAYS, *BLOCKERS)) | F.regexp_like(t, F.lit("[.!?]$")) | (F.size(F.split(t, r"\s+")) > 4)
    bad = bad | ((F.upper(t) == t) & (F.lower(t) != t) & F.contains(t, F.lit(" "))) | (F.size(F.filter(tokens, lambda w: w.isin(*FUNCTION_WORDS))) > 1)
    return F.when((t != "") & ~bad, brand(t))


def title_tail(title: Column) -> Column:
    """What stands behind the last dash or bar of a title, if it is of 2 to 40 characters."""
    return found(title, r"\s+[-—|]\s+([^-—|]{2,40})\s*$", 1)


def site_name(given: Column, page_title: Column, title: Column, url: Column) -> Column:
    """The first valid one of the given name and the titles' tails; else the host without its last label, as words."""
    base = F.regexp_replace(host(url), r"\.[^.]*$", "")
    words = F.regexp_extract_all(F.translate(base, "-.", "  "), F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    derived = F.nullif(F.array_join(F.transform(words, lambda w: F.initcap(w)), ""), F.lit(""))
    return F.coalesce(valid_site_name(given), valid_site_name(title_tail(page_title)), valid_site_name(title_tail(title)), brand(derived))


def doc_prefix(title: Column, cite: Column, year: Column) -> Column:
    """Title (cite or year), the title cut at a word within 60 characters."""
    cut = F.when(F.length(title) > 60, F.concat(F.regexp_replace(F.substring(title, 1, 60), " [^ ]*$", ""), F.lit("…"))).otherwise(title)
    return F.concat(cut, F.coalesce(F.concat(F.lit(" ("), F.coalesce(cite, year.cast("string")), F.lit(")")), F.lit("")))


def badge_cost(cost: Column) -> Column:
    return F.when(cost.isNull(), "—").when(cost == 0, "$0").when(cost < 0.01, F.format_string("$%.4f", cost)).otherwise(F.format_string("$%.2f", cost))


def badge_ms(ms: Column) -> Column:
    return F.when(ms.isNull(), "—").when(ms < 1000, F.format_string("%d ms", ms.cast("long"))).otherwise(F.format_string("%.1f s", ms / 1000))


def cursor_token(*values: Column) -> Column:
    """base64url of the JSON array of the values."""
    return F.translate(F.base64(F.encode(F.to_json(F.array(*(v.cast("string") for v in values))), "UTF-8")), "+/\r\n", "-_")


def cursor_values(token: Column) -> Column:
    """The values of a cursor; null for what is none."""
    json = F.try_validate_utf8(F.try_to_binary(F.translate(token, "-_", "+/"), F.lit("base64")).cast("string"))
    return F.from_json(json, "array<string>")


def clean_title(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^[\"']+|[\"']+$", ""), "[.!?]+$", "")), 1, 80)


# What a log line of each stage holds, the latest stage first
LOG_STAGES = (
    ("embedding", r"[0-9]+ parents, [0-9]+ children — embedding"),
    ("chunking", r"Found [0-9]+ file\(s\) to process\.|^\[\w[\w.]*\]$"),
    ("parsing", r"→ parse_start:|\[progress\].*parse_pending=|Processing pages|MFR Predict|OCR-rec Predict|/file_parse"),
    ("fetching", r"\[discover:.*\] (triggering|waiting up to)|running batched fetch\+parse|\(fetch_pipeline\)|Pipeline done:"),
)


def line_stage(line: Column) -> Column:
    """The stage that a log line speaks of; null for none."""
    stage = F.lit(None).cast("string")
    for name, pattern in reversed(LOG_STAGES):
        stage = F.when(F.regexp_like(line, F.lit(pattern)), name).otherwise(stage)
    return stage


def derive_title(override: Column, url: Column) -> Column:
    arxiv = extract_arxiv(url)
    segment = F.nullif(F.element_at(F.split(F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/+$", ""), "/"), -1), F.lit(""))
    return F.coalesce(F.nullif(F.trim(override), F.lit("")), F.concat(F.lit("arXiv:"), arxiv), F.translate(segment, "-_", "  "), host(url))


def citation_numbers(answer: Column) -> Column:
    """Numbers above 0 in [n] and [n, m] anywhere, distinct and in ascending order."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[([0-9]+(?:,\s*[0-9]+)*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r",\s*"), lambda n: n.try_cast("int"))))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n > 0)))


def title_url(url: Column, kind: Column, title: Column) -> Column:
    """The URL, or for a source of unknown type without one the first that its title contains; empty for none."""
    known = F.trim(F.coalesce(url, F.lit("")))
    inside = F.regexp_extract(F.coalesce(title, F.lit("")), r"(https?://\S+)", 1)
    return F.when((known == "") & F.coalesce(kind == "SourceType.UNKNOWN", F.lit(False)), inside).otherwise(known)


def phrase_quote(text: Column) -> Column:
    """A phrase for a full-text index: in double quotes, those inside doubled."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def phrase_text(text: Column) -> Column:
    """Words of letters and digits in lower case, a blank around each: a phrase matches where this contains the phrase's own."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "), F.lit(" "))


def split_author_string(text: Column) -> Column:
    """Names by semicolons, or by lines where there are none: commas belong to names."""
    parts = F.when(F.contains(text, F.lit(";")), F.split(text, ";")).otherwise(F.split(text, "\n"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown_table(headers: list[str], rows: Column) -> Column:
    """An array of arrays of texts under the headers; empty for no rows."""
    head = "| " + " | ".join(headers) + " |\n|" + "|".join("---" for _ in headers) + "|\n"
    return F.when(F.size(rows) > 0, F.concat(F.lit(head), F.array_join(F.transform(rows, table_row), "\n"))).otherwise("")


def key_value_table(rows: Column) -> Column:
    """An array of arrays (key, value) as a table of two columns without headers."""
    return F.concat(F.lit("|  |  |\n|---|---|\n"), F.array_join(F.transform(rows, table_row), "\n"))


def mermaid_label(text: Column) -> Column:
    """White space collapsed, double quotes made single, 48 characters at most."""
    return F.substring(F.replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit('"'), F.lit("'")), 1, 48)
