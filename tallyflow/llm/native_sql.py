"""SQL of the queries that use DataFrame functions only."""

from __future__ import annotations

from tallyflow.llm.known_licenses import LICENSES, NOTICES
from tallyflow.llm.license_scan import (
    _BODY,
    _OPENING,
    _TITLE,
    NAMED_LINE,
    NOTICE_WORDS,
    PUNCTUATION,
    SIGNED,
    SIGNED_LINE,
    spelling_rules,
)
from tallyflow.llm.mixing import FRACTION, MARGINS, NONE, ROUNDS, SEED, TEMPER

def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    x = f"translate(lower(coalesce({text}, '')), chr(1) || chr(2), '')"
    x = f"regexp_replace({x}, {_literal(f'({_OPENING})')}, chr(2) || chr(1) || '\\1', 'g')"
    x = f"regexp_replace({x}, {_literal(f'({_TITLE})')}, chr(1) || '\\1', 'g')"
    shortened = f"CASE WHEN suffix(s, chr(2)) THEN regexp_replace(s, {_literal(f'(?s){SIGNED}.*')}, ' ') ELSE s END"
    x = f"translate(array_to_string(list_transform(string_split({x}, chr(1)), lambda s: {shortened}), ''), chr(2), '')"
    line = lambda rule: f"regexp_matches(l, {_literal('^(?:' + rule + ')')})"
    named = f"{line(NAMED_LINE + r'[^\s]')} AND NOT {line(NAMED_LINE + _BODY)}"
    kept = f"CASE WHEN {line(SIGNED_LINE)} OR ({named}) THEN '' ELSE l END"
    x = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {kept}), chr(10))"
    x = f"trim(regexp_replace({x}, {_literal(PUNCTUATION)}, ' ', 'g'))"
    for pattern, new in spelling_rules():
        x = f"regexp_replace({x}, {_literal(pattern)}, {_literal(new)} || '\\1', 'g')"
    return x


def _known(texts: dict[str, str]) -> str:
    rows = ", ".join(f"({_literal(name)}, {_literal(text)})" for name, text in sorted(texts.items()))
    return f"""SELECT sha256(c) AS known_digest, min(name) AS name
  FROM (SELECT name, {_canonical('text')} AS c FROM (VALUES {rows}) t(name, text)) WHERE c <> '' GROUP BY c"""


def license_sql() -> str:
    return f"""
WITH licenses AS ({_known(LICENSES)}),
notices AS ({_known(NOTICES)}),
d AS (SELECT doc_id, sha256({_canonical('text')}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
found AS (
  SELECT l.doc_id, n.name FROM (SELECT doc_id, sha256({_canonical('line')}) AS digest FROM lines
                               WHERE regexp_matches(lower(line), {_literal(NOTICE_WORDS)})) l
  JOIN notices n ON l.digest = n.known_digest),
counted AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT name, ',' ORDER BY name) AS notices
            FROM found GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.name AS license, coalesce(c.n_notices, 0) AS n_notices, coalesce(c.notices, '') AS notices
FROM d LEFT JOIN licenses k ON d.digest = k.known_digest LEFT JOIN counted c ON d.doc_id = c.doc_id"""


def _share(chars: str) -> str:
    return f"(length(text) - length(translate(text, {_literal(chars)}, ''))) / length(text)"


def mixing_sql() -> str:
    lines = "(length(text) - length(replace(text, chr(10), '')) + 1)"
    parts = [
        f"""d AS (
  SELECT doc_id, text, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
         CASE WHEN coalesce(length(text), 0) = 0 THEN '{NONE}'
              WHEN {_share('|')} > 0.02 THEN 'table'
              WHEN {_share('#*$%&<>!')} > 0.02 THEN 'marks'
              WHEN {_share('0123456789')} > 0.05 THEN 'numbers'
              WHEN length(text) / {lines} < 60 THEN 'lines'
              ELSE 'prose' END AS topic,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM documents)""",
        """cells AS (
  SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS DOUBLE) AS w0
  FROM d GROUP BY source, lang, topic)""",
    ]
    for margin in MARGINS:
        parts.append(
            f"""target_{margin} AS (
  SELECT {margin}, raised / sum(raised) OVER () AS share
  FROM (SELECT {margin}, pow(CAST(sum(tokens) AS DOUBLE), {TEMPER[margin]}) AS raised FROM cells GROUP BY {margin})
  WHERE raised > 0)"""
        )
    step, last = 0, "cells"
    for _ in range(ROUNDS):
        for margin in MARGINS:
            parts.append(
                f"""r{step + 1} AS (
  SELECT c.source, c.lang, c.topic, c.tokens,
         coalesce(w{step} * t.share / nullif(sum(w{step}) OVER (PARTITION BY c.{margin}), 0), 0) AS w{step + 1}
  FROM {last} c LEFT JOIN target_{margin} t ON c.{margin} = t.{margin})"""
            )
            step += 1
            last = f"r{step}"
    parts += [
        f"""rated AS (
  SELECT *, w{step} / tokens AS rate,
         {FRACTION} * (SELECT sum(tokens) FROM cells) AS goal,
         sum(w{step}) OVER () - sum(w{step}) OVER o + w{step} AS rest_weight,
         sum(tokens) OVER o - tokens AS full_tokens
  FROM {last} WHERE w{step} > 0
  WINDOW o AS (ORDER BY w{step} / tokens DESC, source, lang, topic ROWS UNBOUNDED PRECEDING))""",
        # The scale at which exactly the cells before this one are capped; the first that leaves this one uncapped holds.
        """scaled AS (
  SELECT arg_min(greatest(0, goal - full_tokens) / rest_weight, full_tokens) AS scale
  FROM rated WHERE greatest(0, goal - full_tokens) / rest_weight * rate < 1)""",
        f"""p AS (
  SELECT source, lang, topic, least(1, coalesce((SELECT scale FROM scaled), 1e18) * w{step} / tokens) AS probability
  FROM {last} WHERE tokens > 0)""",
    ]
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT d.doc_id, d.topic, CAST(d.tokens AS BIGINT) AS tokens, round(coalesce(p.probability, 0), 6) AS probability,
       CAST(('0x' || substr(md5('{SEED} ' || d.doc_id), 1, 13)) AS BIGINT) / pow(2, 52) < coalesce(p.probability, 0) AS sampled
FROM d LEFT JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""
    )
