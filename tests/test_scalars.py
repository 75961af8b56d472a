"""Text, URL, status, answer and page expressions against literals and the standard library."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from waymark.functions import answers, pages, status, text, urls

PADS = ["", " a ", "\ta\n", " a ", "\x1ca\x1f", "a b", "　", None]


def test_strip_is_unicode_aware(column):
    assert column(text.strip, PADS) == [None if p is None else p.strip() for p in PADS]
    assert column(text.clean_text, PADS) == [(p or "").strip() for p in PADS]


def test_squeeze(column):
    values = ["  a \t\n b  c ", "a", ""]
    assert column(text.squeeze_ws, values) == [" ".join(v.split()) for v in values]


def test_truncation_counts_characters(column):
    values = ["x" * 500, "x" * 501, "\U0001f600" * 501, "", None]
    out = column(text.truncate_content, values)
    assert out[:2] == ["x" * 500, "x" * 500 + "..."]
    assert out[2] == "\U0001f600" * 500 + "..."
    assert out[3:] == ["", None]


def test_truncation_twice_is_once(column):
    once = column(text.truncate_content, ["y" * 900])
    assert column(text.truncate_content, once) == once


def test_distinct_first(spark):
    df = spark.createDataFrame([(["A", "b", "a", "B", "c", "d"],)], "q array<string>")
    assert df.select(text.distinct_first("q", 3)).first()[0] == ["A", "b", "c"]
    with pytest.raises(ValueError):
        text.distinct_first("q", 0)


def test_phrase_form(column):
    assert column(text.phrase_form, ["  Faculty & Staff! ", "É-2", "--"]) == [
        "faculty staff",
        "é 2",
        "",
    ]


# (written, normal form)
URLS = [
    ('https://example.edu/staff', 'https://example.edu/staff'),
    ('https://example.edu/staff#section', 'https://example.edu/staff'),
    ('HTTPS://EXAMPLE.EDU/Staff', 'https://example.edu/Staff'),
    (None, None),
    ('', None),
    ('not-a-url', None),
    ('ftp://example.com', None),
    ('  https://example.edu  ', 'https://example.edu/'),
    ('https://u:p@Host.Example:8080/a?b=c&d=#x', 'https://u:p@host.example:8080/a?b=c&d='),
    ('http://host?', 'http://host/'),
    ('http://host/?', 'http://host/'),
    ('http://host?q', 'http://host/?q'),
    ('http://host#frag?x', 'http://host/'),
    ('https://', 'https:///'),
    ('http:///path', 'http:///path'),
    ('http://my_host/a b/c', 'http://my_host/a b/c'),
    ('http://ho\tst/a\nb', 'http://host/ab'),
    ('http://[::1]:80/x', 'http://[::1]:80/x'),
    ('http://[::1/x', None),
    ('http://::1]/x', None),
    ('http://a[b]/x', None),
    ('http://ho\uff0fst/x', None),
    ('http://host/é?ü', 'http://host/é?ü'),
    ('\xa0https://x.org\u2003', 'https://x.org/'),
    ('http://x/a?b?c#d#e', 'http://x/a?b?c'),
]


def test_sanitize_url(column):
    assert column(urls.sanitize_url, [u for u, _ in URLS]) == [want for _, want in URLS]


def test_first_url(column):
    values = ['see (https://a.b/c) "http://d"', "HTTP://X.y.", "https://a b", "none", None]
    assert column(urls.first_url, values) == [
        "https://a.b/c",
        "HTTP://X.y.",
        "https://a",
        None,
        None,
    ]


def test_keys(column):
    assert column(urls.url_key, [" HTTP://A/B# ", "  ", None]) == ["http://a/b#", None, None]
    q = 'café "x"'
    assert column(urls.query_key, [q]) == [hashlib.sha1(q.encode("utf-8")).hexdigest()]
    assert column(urls.url_host, ["https://u@Www.X.org:80/a", "x"]) == ["www.x.org", ""]


def test_status(column):
    cells = [None, " ", " NaN ", "None", "NOT_FOUND", " error_not_found ", "junk", "http://a"]
    assert column(status.status_of, cells) == [
        "pending",
        "pending",
        "pending",
        "pending",
        "not_found",
        "error",
        "found",
        "found",
    ]
    assert column(status.is_pending, cells) == [True] * 6 + [False] * 2


def test_fetch_outcome(spark):
    rows = [
        (None, "ReadTimeout", "retryable"),
        (None, "ConnectError", "retryable"),
        (None, "Other", "fatal"),
        (429, None, "retryable"),
        (500, None, "retryable"),
        (599, None, "retryable"),
        (600, None, "fatal"),
        (422, None, "empty"),
        (404, None, "fatal"),
        (301, None, "fatal"),
        (200, None, "ok"),
        (None, None, "fatal"),
    ]
    df = spark.createDataFrame(rows, "status int, error string, want string")
    got = df.select("want", status.fetch_outcome("status", "error").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


MALFORMED = "Extracted from malformed response"
NO_RESPONSE = "No response from model"
# (raw answer, (url, confidence, reasoning))
ANSWERS = [
    (
        '{"selected_index": 1, "selected_url": "https://example.edu/staff", "confidence": "high", "reasoning": "Official school domain"}',
        ('https://example.edu/staff', 'high', 'Official school domain'),
    ),
    (
        '{"selected_index": 0, "selected_url": null, "confidence": "low", "reasoning": "none"}',
        ('NOT_FOUND', 'low', 'none'),
    ),
    (
        None,
        ('ERROR_NOT_FOUND', None, NO_RESPONSE),
    ),
    (
        '',
        ('ERROR_NOT_FOUND', None, NO_RESPONSE),
    ),
    (
        '   ',
        ('NOT_FOUND', 'low', MALFORMED),
    ),
    (
        'Here is the URL: https://example.edu/staff-directory and more text',
        ('https://example.edu/staff-directory', 'low', MALFORMED),
    ),
    (
        '{"selected_url":"http://a/","selected_url":"http://b/"}',
        ('http://b/', None, ''),
    ),
    (
        '{"selected_url":"HTTP://A"} trailing https://t.org/x',
        ('http://a/', 'low', MALFORMED),
    ),
    (
        '{"selected_url":"http://a/"} {"selected_url":"http://b/"}',
        ('http://a/', 'low', MALFORMED),
    ),
    (
        '{"selected_url":"http://a/"}}',
        ('http://a/', 'low', MALFORMED),
    ),
    (
        "{'selected_url':'http://q/'}",
        ('http://q/', 'low', MALFORMED),
    ),
    (
        '{}',
        ('NOT_FOUND', None, ''),
    ),
    (
        '[]',
        ('NOT_FOUND', 'low', MALFORMED),
    ),
    (
        '["https://in.list/x"]',
        ('https://in.list/x', 'low', MALFORMED),
    ),
    (
        '"https://in.string/x"',
        ('https://in.string/x', 'low', MALFORMED),
    ),
    (
        'null',
        ('NOT_FOUND', 'low', MALFORMED),
    ),
    (
        '12',
        ('NOT_FOUND', 'low', MALFORMED),
    ),
    (
        '  {"selected_url":null,"reasoning":null}\n',
        ('NOT_FOUND', None, None),
    ),
    (
        '{"selected_url":["http://x/"],"confidence":"high"}',
        ('NOT_FOUND', 'high', ''),
    ),
    (
        '{"selected_url":"ftp://x","confidence":"low","reasoning":null}',
        ('NOT_FOUND', 'low', None),
    ),
    (
        '{"selected_url":"http://a/",}',
        ('http://a/', 'low', MALFORMED),
    ),
    (
        '{"selected_url":"http://a/","confidence":bad}',
        ('http://a/', 'low', MALFORMED),
    ),
    (
        '{"selected_url":"http://a/","confidence":"x","extra":{"y":[1]}}',
        ('http://a/', 'x', ''),
    ),
    (
        '{"selected_url":NaN,"confidence":"low"}',
        ('NOT_FOUND', 'low', ''),
    ),
    (
        '{"selected_url":"http://a/\\u00e9","reasoning":"li\\nne"}',
        ('http://a/é', None, 'li\nne'),
    ),
    (
        '{"selected_url":"NOT_FOUND"}',
        ('NOT_FOUND', None, ''),
    ),
    (
        '```json\n{"selected_url":"https://fenced.org/a"}\n```',
        ('https://fenced.org/a', 'low', MALFORMED),
    ),
    (
        '{"selected_url":"http://a/","n":01}',
        ('http://a/', 'low', MALFORMED),
    ),
    (
        '\xa0{"selected_url":"http://a/"}',
        ('http://a/', 'low', MALFORMED),
    ),
]


def test_parse_selection(column):
    got = column(answers.parse_selection, [raw for raw, _ in ANSWERS])
    for (raw, want), found in zip(ANSWERS, got, strict=True):
        assert tuple(found) == want, raw


def test_response_text(column):
    nested = {
        "output_text": "",
        "output": [
            {"type": "reasoning"},
            {"type": "message", "content": [{"type": "output_text", "text": " a"}]},
            {"type": "message", "content": [{"type": "refusal", "text": "no"}]},
            {"type": "message", "content": [{"type": "output_text", "text": "b "}]},
        ],
    }
    values = ['{"output_text": " x "}', json.dumps(nested), '{"output": []}', "junk", None]
    assert column(answers.response_text, values) == ["x", "ab", "", "", ""]


def test_page_signals(spark):
    rows = [
        ("Staff", "https://a.org/", "candidate"),
        ("Home", "https://www.facebook.com/x", "social"),
        ("Staff", "https://www.niche.com/k12", "aggregator"),
        ("Home", "https://notniche.com/k12", "candidate"),
        ("Contact Us", "https://a.org/x", "contact"),
        ("Contact Us and Staff Directory", "https://a.org/x", "candidate"),
        ("About us", "https://a.org/", "about"),
        ("News", "https://a.org/", "news"),
        ("Newsom", "https://a.org/", "candidate"),
        ("School Calendar", "https://a.org/", "calendar"),
        (None, None, "candidate"),
    ]
    df = spark.createDataFrame(rows, "title string, url string, want string")
    got = df.select("want", pages.page_class("title", "url").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]

    text_ = spark.createDataFrame([("a@b.org, c.d@e.co.uk (555) 123-4567 555.123.4567 x@y",)], "c string")
    assert tuple(text_.select(pages.contact_signals("c")).first()[0]) == (2, 2)

    fit = spark.createDataFrame(
        [
            ("Lincoln High School", "Portland", "Lincoln High", "https://x.org"),
            ("Lincoln High School", "Portland", "Home", "https://portland.k12.or.us"),
            ("", "", "Home", "https://x.org"),
        ],
        "n string, d string, t string, u string",
    ).select(pages.specificity("n", "d", "t", "u").alias("s"), "t")
    got = {(round(r.s.share, 2), r.s.specific, r.s.district_only) for r in fit.collect()}
    assert got == {(0.67, True, False), (0.0, False, True), (0.0, False, False)}
    staff = df.select(F.col("title"), pages.staff_signals("title", "url").alias("s")).first()
    assert tuple(staff.s) == (True, False)
