"""Names, word lists and patterns that results depend on, as given. Patterns ignore case."""

from __future__ import annotations

# Numbers of a node, in their order.
NUMERIC_FEATURES = (
    "log_descendant_text_length",
    "log_descendant_paragraph_count",
    "descendant_link_text_fraction",
    "log_dom_depth",
    "relative_document_position",
    "has_datetime_attribute",
    "contains_absolute_date",
    "contains_relative_date",
    "log_word_count",
    "capitalized_token_ratio",
    "log_descendant_link_count",
    "contains_by_prefix",
    "contains_written_by",
    "contains_author_attribute",
    "contains_byline_attribute",
    "contains_profile_link",
    "person_name_shape",
    "multiple_name_separator",
    "short_text",
    "inside_header",
    "contains_published_marker",
    "contains_updated_marker",
    "contains_reading_time",
    "tag_is_time",
    "itemprop_date_published",
    "itemprop_date_modified",
    "log_direct_child_count",
    "log_descendant_span_count",
    "is_leaf",
    "direct_text_fraction",
    "inside_article",
    "inside_main",
    "distance_from_title",
    "before_title",
    "same_parent_as_title",
    "log_tree_distance_from_title",
    "distance_from_date",
    "before_date",
    "same_parent_as_date",
    "log_tree_distance_from_date",
    "after_title",
    "near_title",
    "distance_from_article_start",
    "distance_from_article_end",
    "before_article",
    "after_article",
    "near_document_end",
    "contains_acknowledgements_marker",
    "contains_contributor_marker",
)

# Words of attributes and the roles that they name.
ROLE_WORDS = {
    "author": "author",
    "authors": "author",
    "byline": "byline",
    "contributor": "contributor",
    "contributors": "contributor",
    "profile": "profile",
    "person": "person",
    "people": "person",
    "team": "team",
    "date": "date",
    "published": "published",
    "publish": "published",
    "updated": "updated",
    "update": "updated",
    "modified": "modified",
    "headline": "headline",
    "title": "title",
    "summary": "summary",
    "subtitle": "subtitle",
    "subhead": "subtitle",
    "standfirst": "summary",
    "dek": "summary",
    "excerpt": "summary",
    "description": "summary",
    "lead": "summary",
    "acknowledgement": "acknowledgements",
    "acknowledgements": "acknowledgements",
    "acknowledgment": "acknowledgements",
    "acknowledgments": "acknowledgements",
    "content": "content",
}

# Phrases of a node's text.
DATE_LIKE = (
    r"(?:\b(?:19|20)\d{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])\b)"
    r"|(?:\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+(?:19|20)\d{2}\b)"
)
NUMBER = r"(?:an?|one|two|three|four|five|six|seven|eight|nine|ten|\d+)"
RELATIVE_DATE = r"\b(?:an?|one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s+(?:minute|hour|day|week|month|year)s?\s+ago\b"
READING_TIME = r"\b(?:an?|one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s*(?:min(?:ute)?s?|hours?)\s+(?:read|reading)\b"
BY_PREFIX = r"^\s*(?:by\b|written\s+by\b|author\s*:?)"
BY_COLON = r"^\s*by\s*:"
WRITTEN_BY = r"^\s*written\s+by\b"
WRITTEN_BY_ANY = r"\bwritten\s+by\b"
ARTICLE_WRITTEN_BY = r"^\s*(?:this\s+)?article\s+(?:was\s+)?written\s+by\b"
AUTHOR_LABEL = r"^\s*authors?\s*:"
ACKNOWLEDGEMENTS = r"\backnowledg(?:e)?ments?\b"
CONTRIBUTOR = r"\bcontributors?|contributions?\b"
THANKS_TO = r"\b(?:special\s+)?thanks\s+to\b"
AND_LAST_NAME = r"(?:\band\b|&)\s+[\w.'’\-]+(?:\s+[\w.'’\-]+){0,4}[.!]?\s*$"
ORGANIZATION_AUTHOR = r"\b(?:engineering|research|developer|platform|security|infrastructure|applied\s+ai)\s+team\b|\bteam\b"
AUTHOR_ROLE = r"\b(?:engineer|researcher|scientist|member|staff|director|lead|manager|editor)\b"
PUBLISHED_MARKER = r"\b(?:publish(?:ed)?|posted)\b"
UPDATED_MARKER = r"\b(?:updated?|modified)\b"
MULTIPLE_NAME = r"(?:\s(?:and|und|et|y)\s|[,;&/·•])"
PROFILE_LINK = r"(?:/|\b)(?:author|authors|profile|people|person|team|contributors?)(?:/|\b)|/@"
AUTHOR_ATTRIBUTE = r"\b(?:author|authors|contributor|contributors|profile|person|people)\b"
BYLINE_ATTRIBUTE = r"\b(?:byline|written[\s_-]*by)\b"
HANDLE = r"@[\w.-]+"

# Number words of relative dates.
NUMBER_WORDS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}

# Page chrome: subtrees without nodes of their own, dropped elements, names, roles, elements that are pruned when empty.
EXCLUDED_SUBTREES = frozenset({"head", "script", "style", "noscript", "template"})
CHROME_DROP_TAGS = frozenset(
    {"aside", "audio", "button", "canvas", "dialog", "embed", "footer", "form", "head", "iframe", "img", "input", "nav", "noscript", "object", "picture", "script", "select", "source", "style", "svg", "template", "track", "video"}
)
CHROME_TOKENS = (
    r"\b(?:backdrop|breadcrumb|comments?|consent|cookie|drawer|footer|lightbox|menu|modal|newsletter|overlay|pagination|popup|promo|"
    r"recommend(?:ation|ations|ed)?|related|share|sidebar|social|subscribe|toast)\b"
)
HERO_OVERLAY = r"\b(?:image|hero)\s+overlay\b"
OVERLAY_TOKEN = r"\boverlay\b"
EXTRACTION_TOKENS = r"author|byline|date|publish|time|headline|title|subtitle|sub-title|subhead|standfirst|dek|excerpt|description|lead"
CHROME_ROLES = frozenset({"alertdialog", "contentinfo", "dialog", "navigation", "search"})
HIDDEN_STYLE = r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!important)?\s*(?:;|$)"
PRUNED = frozenset({"div", "figure", "p", "section", "span"})
