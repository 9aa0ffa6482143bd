"""Text and contact features as Column expressions; nothing leaves the JVM.

Every function takes Columns. Null counts as the empty text unless stated. ``(?U)`` makes regular-expression classes Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns, word groups and mail hosts that feature values depend on.
URL = r"(?i)(?:https?://|www\.)[^\s<>\"'\[\]]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)(?<![\w.])\+?\d(?:[ \-.()]{0,2}\d){6,14}(?!\w)"
TEMPLATE_PHONE = r"\+?\d[\d\-\s()]{5,}\d"
KEYWORDS = {
    "kw_money": r"money|earn|income|profit|cash|invest|loan|financial|\$\s?\d",
    "kw_crypto": r"crypto|bitcoin|\bbtc\b|ethereum|binance|wallet|\bnft\b|metamask|blockchain",
    "kw_seo": r"\bseo\b|backlink|ranking|\branks?\b|traffic|domain authority|\bmoz\b|google|web ?site|web design",
    "kw_pharma": r"viagra|cialis|pharmac|\bpills?\b|stromectol|ivermectin|prescription",
    "kw_adult": r"\bsex|dating|porn|\badult\b|escort|\bgirls\b|\bnude|xxx",
    "kw_gambling": r"casino|\bbet\b|betting|\bslots?\b|poker|gambl",
    "kw_unsub": r"unsubscribe|opt[ -]?out",
}
FREE_MAIL = "gmail.com yahoo.com hotmail.com outlook.com aol.com icloud.com live.com msn.com protonmail.com gmx.com ymail.com googlemail.com".split()
RU_MAIL = "mail.ru list.ru bk.ru inbox.ru rambler.ru yandex.ru yandex.com ya.ru".split()
ATTACKS = {
    "sql_injection": r"(?i)(union\s+select|drop\s+table|or\s+1\s*=\s*1|xp_cmdshell|information_schema)",
    "xss": r"(?i)(<script|javascript:|onerror\s*=|onload\s*=|<iframe)",
    "path_traversal": r"(\.\./|\.\.\\)",
    "command_injection": r"(;|\||&&|\$\(|`)",
}
MASKS = r"<(?:EMAIL|PHONE|SITE|NAME)>"


def stripped(text: Column) -> Column:
    """Without outer Unicode white space; null becomes empty."""
    return F.coalesce(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def chars_in(text: Column, klass: str) -> Column:
    """Number of characters of a regular-expression class, such as ``\\p{L}``."""
    return F.char_length(F.regexp_replace(text, f"[^{klass}]+", ""))


def occurrences(text: Column, literal: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def mask_pii(text: Column, name: Column | None = None, site: str | None = None) -> Column:
    """E-mail, phone, the own site and the sender's name as tokens.

    A text that is the name itself becomes ``<NAME>``; inside a text a name is masked from five characters and two words on.
    """
    t = stripped(text)
    out = F.regexp_replace(F.regexp_replace(t, EMAIL, "<EMAIL>"), PHONE, "<PHONE>")
    if site:
        out = F.regexp_replace(out, f"(?i){site}(?:\\.[a-z]{{2,6}})?", "<SITE>")
    if name is None:
        return out
    n = stripped(name)
    literal = F.concat(F.lit(r"(?iu)\Q"), F.replace(n, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    inside = F.when((F.char_length(n) >= 5) & (F.size(F.split(n, r"(?U)\s+")) >= 2), F.regexp_replace(out, literal, F.lit("<NAME>"))).otherwise(out)
    return F.when(t == "", "").when((n != "") & (F.lower(t) == F.lower(n)), "<NAME>").otherwise(inside)


def template_v1(text: Column) -> Column:
    """Structure of a message with its specific values dropped, by Unicode classes; mask tokens keep their upper case."""
    t = F.lower(stripped(text))
    for pattern, token in ((EMAIL, "<EMAIL>"), (r"(?U)https?://[^\s]+", "<URL>"), (r"(?U)\+?\d[\d\-\s()]{5,}\d", "<PHONE>"), (r"(?U)\b\d+\b", "<NUM>"), (r"(.)\1{3,}", "<REPEAT>")):
        t = F.regexp_replace(t, pattern, token)
    for token in ("email", "phone", "site", "name"):
        t = F.replace(t, F.lit(f"<{token}>"), F.lit(f"<{token.upper()}>"))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def template_v2(text: Column) -> Column:
    """The same by ASCII classes, without restoring mask tokens: the grammar of signatures."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for pattern, token in ((EMAIL, "<EMAIL>"), (r"https?://[^\s]+", "<URL>"), (TEMPLATE_PHONE, "<PHONE>"), (r"(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])", "<NUM>"), (r"(.)\1{3,}", "<REPEAT>")):
        t = F.regexp_replace(t, pattern, token)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def template_id(text: Column) -> Column:
    """Twelve hex digits of the SHA-1 of the template; empty for an empty template."""
    t = template_v1(text)
    return F.when(t == "", "").otherwise(F.substring(F.sha1(t), 1, 12))


def signature_hash(pattern: Column) -> Column:
    return F.sha2(pattern, 256)


def normalized(text: Column) -> Column:
    """Lower case with single blanks and no outer ones."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def joined_fields(*fields: Column) -> Column:
    """The present fields joined by `` | ``."""
    return F.concat_ws(" | ", *fields)


def tokens(text: Column) -> Column:
    """Words between white space; empty ones and ``0`` are dropped."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: ~x.isin("", "0"))


def word_ngrams(text: Column, n: int = 3) -> Column:
    """Runs of ``n`` words; an empty array for texts of fewer words."""
    w = tokens(text)
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))


def levenshtein_ratio(a: Column, b: Column, prefix: int = 255) -> Column:
    """1 - distance of the first ``prefix`` bytes / bytes of the longer text; 1 for two empty texts.

    A character of the 8-bit code stands for each byte.
    """
    a, b = (F.decode(F.encode(x, "UTF-8"), "ISO-8859-1") for x in (a, b))
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(F.left(a, F.lit(prefix)), F.left(b, F.lit(prefix))) / longest)


def repetitive(text: Column, threshold: int = 10) -> Column:
    """Whether a character follows itself ``threshold`` times, or a word occurs ``threshold`` times."""
    w = F.array_sort(tokens(text))
    places = F.when(F.size(w) >= threshold, F.sequence(F.lit(1), F.size(w) - (threshold - 1)))
    often = F.coalesce(F.exists(places, lambda i: F.element_at(w, i) == F.element_at(w, i + (threshold - 1))), F.lit(False))
    return F.coalesce(text.rlike(rf"(.)\1{{{threshold},}}"), F.lit(False)) | often


def email_valid(email: Column) -> Column:
    return F.coalesce(email.rlike(f"^{EMAIL}$"), F.lit(False))


def attacks(text: Column) -> Column:
    """The kinds of attack pattern that a text contains."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in ATTACKS.items()]))


def char_entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    n = F.char_length(text)
    counted = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c != "", n - F.char_length(F.replace(text, c, F.lit("")))))
    terms = F.filter(counted, lambda x: x > 0)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc - (x / n) * F.log2(x / n)))


def script_of(text: Column) -> Column:
    """cyrillic, latin (ASCII), other or none, by more than half of the letters outside mask tokens."""
    t = F.regexp_replace(stripped(text), MASKS, " ")
    n = chars_in(t, r"\p{L}")
    return (
        F.when(n == 0, "none").when(chars_in(F.regexp_replace(t, r"[^\p{L}]+", ""), r"\x{400}-\x{4FF}") * 2 > n, "cyrillic").when(chars_in(t, "A-Za-z") * 2 > n, "latin").otherwise("other")
    )


def text_features(text: Column) -> dict[str, Column]:
    """The numeric features of a masked message by name."""
    t = stripped(text)
    core = F.regexp_replace(t, MASKS, " ")
    inner = stripped(core)
    n = F.char_length(inner)
    words = F.regexp_extract_all(core, F.lit(r"(?U)(\w+)"), F.lit(1))
    letters = chars_in(core, r"\p{L}")
    out = {
        "msg_len": F.char_length(t),
        "word_count": F.size(words),
        "avg_word_len": share(F.char_length(F.array_join(words, "")), F.size(words)),
        "line_count": F.when(t == "", 0).otherwise(occurrences(t, "\n") + 1),
        "url_count": F.regexp_count(t, F.lit(URL)),
        "email_mentions": occurrences(t, "<EMAIL>"),
        "phone_mentions": occurrences(t, "<PHONE>"),
        "digit_ratio": share(chars_in(core, r"\p{Nd}"), n),
        "upper_ratio": share(chars_in(core, r"\p{Lu}"), letters),
        "special_ratio": share(F.char_length(F.regexp_replace(core, r"(?U)[\p{L}\p{N}\s]+", "")), n),
        "non_ascii_ratio": share(F.char_length(F.regexp_replace(core, r"[\x00-\x7F]+", "")), n),
        "cyrillic_ratio": share(chars_in(core, r"\x{400}-\x{4FF}"), letters),
        "char_entropy": char_entropy(inner),
        "exclam_count": occurrences(core, "!"),
        "has_bbcode": flag(F.lower(core).rlike(r"\[/?url")),
        "has_html": flag(F.lower(core).rlike(r"<a\s|href=|</\w+>")),
        "has_repeat": flag(core.rlike(r"(.)\1{3,}")),
    }
    return out | {k: flag(core.rlike(f"(?iu){p}")) for k, p in KEYWORDS.items()}


def domain_of(email: Column) -> Column:
    """What follows the last ``@``, in lower case; the whole value if it has none."""
    return F.substring_index(F.lower(stripped(email)), "@", -1)


def contact_features(name: Column, email: Column, phone: Column, message: Column) -> dict[str, Column]:
    """The numeric features of the contact fields by name."""
    n, e, p, m = stripped(name), stripped(email), stripped(phone), stripped(message)
    domain = domain_of(e)
    local = F.when(e.contains("@"), F.left(e, F.char_length(e) - F.char_length(domain) - 1)).otherwise("")
    digits = F.regexp_replace(p, r"\D+", "")
    filled = sum((flag(x != "") for x in (n, e, p, m)), F.lit(0))
    return {
        "has_name": flag(n != ""),
        "name_len": F.char_length(n),
        "name_words": F.when(n == "", 0).otherwise(F.size(F.split(n, r"(?U)\s+"))),
        "name_has_digit": flag(n.rlike(r"\p{Nd}")),
        "name_joined": flag(n.rlike(r"(?U)^[A-Z][a-z]+[A-Z]\w*$")),
        "name_equals_msg": flag((n != "") & (F.lower(n) == F.lower(m))),
        "has_email": flag(e != ""),
        "email_valid": flag(email_valid(e)),
        "email_local_len": F.char_length(local),
        "email_local_digits": chars_in(local, r"\p{Nd}"),
        "email_free": flag(domain.isin(FREE_MAIL)),
        "email_ru": flag(domain.isin(RU_MAIL) | domain.endswith(".ru")),
        "has_phone": flag(p != ""),
        "phone_digits": F.char_length(digits),
        "phone_ru_format": flag(digits.rlike("^[78][0-9]{10}$")),
        "phone_has_letters": flag(p.rlike("[A-Za-z]")),
        "field_completion_ratio": filled / F.lit(4.0),
    }


def topic(has_message: Column, text: Column) -> Column:
    """The first group of words that a message falls in."""
    order = (("kw_crypto", "crypto"), ("kw_gambling", "gambling"), ("kw_adult", "adult"), ("kw_pharma", "pharma"), ("kw_seo", "seo / marketing"), ("kw_money", "money"))
    out = F.when(has_message == 0, "no message")
    for key, label in order:
        out = out.when(text.rlike(f"(?iu){KEYWORDS[key]}"), label)
    return out.otherwise("other")
