"""Benchmark tables derived from the given parquet tables.

One SQL text per table, written once for both engines: `SPARK` and `DUCK` spell
the few list functions that differ. Every table covers its whole source and
whole texts. Variation (which answer is wrong, which response failed) follows
from the rows themselves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASE = ["documents", "labels", "conversations", "events"]
TEXTS = ["documents", "conversations"]
# The space separators of Unicode, which DuckDB's trim takes off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@dataclass(frozen=True)
class Dialect:
    name: str

    def split(self, text: str, mark: str) -> str:
        if self.name == "spark":
            return f"split({text}, '[{mark[0]}]{mark[1:]}')"
        return f"string_split({text}, '{mark}')"

    def size(self, items: str) -> str:
        return f"size({items})" if self.name == "spark" else f"len({items})"

    def nth(self, items: str, place: str) -> str:
        if self.name == "spark":
            return f"element_at({items}, {place})"
        return f"list_extract({items}, {place})"

    def numbered(self, items: str) -> str:
        """Lines `1. first`, `2. second`, …"""
        if self.name == "spark":
            each = f"transform({items}, (x, i) -> concat(CAST(i + 1 AS STRING), '. ', x))"
            return f"array_join({each}, chr(10))"
        each = f"list_transform({items}, lambda x, i: concat(CAST(i AS VARCHAR), '. ', x))"
        return f"array_to_string({each}, chr(10))"

    def each(self, source: str, count: int, name: str) -> str:
        """FROM clause with every row of a source once per 0 … count-1."""
        if self.name == "spark":
            return f"{source} LATERAL VIEW explode(sequence(0, {count - 1})) e_{name} AS {name}"
        return f"{source} CROSS JOIN (SELECT unnest(range(0, {count})) AS {name}) e_{name}"

    def text(self, value: str) -> str:
        return f"CAST({value} AS {'STRING' if self.name == 'spark' else 'VARCHAR'})"

    def json(self, text: str) -> str:
        """Text escaped for a JSON string."""
        out = f"replace({text}, chr(92), concat(chr(92), chr(92)))"
        out = f"replace({out}, chr(34), concat(chr(92), chr(34)))"
        return f"replace({out}, chr(10), concat(chr(92), 'n'))"

    def spelled(self, sql: str) -> str:
        """`concat` leaves out nulls and `trim` takes off every space separator, as in DuckDB."""
        if self.name == "spark":
            sql = re.sub(r"\bconcat\(", "concat_ws('', ", sql)
            sql = re.sub(r"\btrim\(", f"trim(BOTH '{SPACES}' FROM ", sql)
        return sql


SPARK, DUCK = Dialect("spark"), Dialect("duck")

# Types in the order the label table deals them out.
LABEL_TYPES = "history_taking,physical_findings,test_interpretation,diagnosis,none,medication_selection,medication_dosage,procedure_intervention,monitoring_management"
MODELS = 11


def _sample(d: Dialect) -> str:
    body = "replace(d.text, chr(10), ' ')"
    return f"""
    SELECT ord, grp, sample_id, {d.numbered("parts")} AS sentences, n_sentences, focus_id, focus,
           error_flag, lang, quality, n_chars,
           CASE WHEN error_flag = 1 THEN concat('type', {d.text("ord % 6")}) END AS error_type,
           CASE WHEN error_flag = 1 AND NOT (quality IS NULL AND lang = 'fr') THEN focus_id END
               AS error_sentence_id,
           CASE WHEN error_flag = 1 THEN focus END AS error_sentence,
           CASE WHEN error_flag = 1 THEN concat('**', focus, '** revised') END AS corrected_sentence
    FROM (SELECT p.*, {d.nth("parts", "focus_id")} AS focus
          FROM (SELECT q.*, CAST(ord % n_sentences + 1 AS INT) AS focus_id
                FROM (SELECT r.*, CAST({d.size("parts")} AS INT) AS n_sentences
                      FROM (SELECT d.doc_id AS ord, CAST(floor(d.doc_id / 3) AS BIGINT) AS grp,
                                   concat('q', {d.text("CAST(floor(d.doc_id / 3) AS BIGINT)")}, '_',
                                          substr('abcde', CAST(floor(d.doc_id / 3) % 5 + 1 AS INT), 1),
                                          '_m', {d.text("d.doc_id % 3")}) AS sample_id,
                                   {d.split(body, ". ")} AS parts,
                                   CASE WHEN (d.doc_id * 7) % 10 < 5 THEN 1 ELSE 0 END AS error_flag,
                                   d.lang, l.quality, d.n_chars
                            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) r) q) p) s"""


def _pred(d: Dialect) -> str:
    return f"""
    SELECT p.*, CAST(CASE WHEN ed_pred = -1 THEN -1 WHEN ed_pred = 0 THEN 0
                          WHEN (ord + m) % 3 = 0 THEN (ord + m) % n_sentences + 1
                          ELSE coalesce(error_sentence_id, 1) END AS BIGINT) AS se_pred
    FROM (SELECT s.*, m, t, lang AS dataset, concat('model', {d.text("m")}) AS model,
                 concat('t', {d.text("t")}) AS template,
                 CASE WHEN (ord * 3 + m * 5 + t) % 29 = 0 THEN -1
                      WHEN (ord * 7 + m * 11 + t * 13) % 10 < 3 + m % 5 THEN 1 - error_flag
                      ELSE error_flag END AS ed_pred
          FROM {d.each(d.each("fx_sample s", MODELS, "m"), 2, "t")}) p"""


def _response(d: Dialect) -> str:
    se = d.text("se_pred")
    return f"""
    SELECT r.*,
           CASE WHEN ed_pred = -1 THEN concat('unable to decide about ', lang)
                WHEN ed_pred = 0 AND ord % 3 = 0 THEN 'CORRECT'
                WHEN ed_pred = 0 AND ord % 3 = 1 THEN concat('```text', chr(10), '_CORRECT_', chr(10), '```')
                WHEN ed_pred = 0 THEN 'エラーなし'
                ELSE concat(lead, answer_text, CASE WHEN ord % 6 = 1 THEN '`' ELSE '' END) END AS content
    FROM (SELECT p.*, concat(trim(replace(focus, '"', '')), ' revised') AS answer_text,
                 CASE ord % 6 WHEN 0 THEN concat({se}, ': ') WHEN 1 THEN concat('`', {se}, ': ')
                              WHEN 2 THEN concat('文', {se}, ': ') WHEN 3 THEN concat({se}, '. ')
                              WHEN 4 THEN concat('文番号: ', {se}, ' ')
                              ELSE concat({se}, '文目: ') END AS lead
          FROM fx_pred p) r"""


def _pair(d: Dialect) -> str:
    """Predictions whose longest common subsequence with the reference is known:
    all their words in even turns, all but the last in odd ones."""
    return """
    SELECT u.conv_id * 1000 + u.turn AS ord, u.conv_id, u.turn, u.role AS dataset,
           CASE WHEN u.conv_id % 11 = 0 THEN 'PARSE_FAILED' WHEN u.conv_id % 7 = 0 THEN '"CORRECT"'
                WHEN u.conv_id % 5 = 0 THEN '' WHEN u.turn % 2 = 0 THEN a.text
                ELSE concat(a.text, ' qqq') END AS prediction,
           CASE WHEN u.conv_id % 6 = 0 THEN '' WHEN u.turn % 2 = 0 THEN concat(u.text, ' ', a.text)
                ELSE concat(a.text, ' zzz ', u.text) END AS reference
    FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1"""


def _judge(d: Dialect) -> str:
    return f"""
    SELECT j.*,
           CASE WHEN unread = 1 THEN 'no verdict'
                ELSE concat('Verdict: {{"ambiguous_error": ', {d.text("c_ambiguous")},
                            ', "multiple_errors": "', {d.text("c_multiple")}, '", "numerical_error": 0, ',
                            CASE WHEN lang = 'de'
                                 THEN concat('"extra_elements": ', {d.text("c_special")}, ', "synthesis_consistency_error": 0')
                                 ELSE concat('"unrealistic_scenario": ', {d.text("c_special")}, ', "inconsistent_context": null') END,
                            ', "explanation": "seen in ', lang, '"}}') END AS output
    FROM (SELECT s.sample_id, s.ord, s.lang, s.error_flag, s.error_type,
                 concat('judge', {d.text("t")}) AS template,
                 CASE WHEN (s.ord + t) % 23 = 0 OR s.lang = 'es' AND s.quality IS NULL THEN 1 ELSE 0 END AS unread,
                 (s.ord + t) % 4 % 2 AS c_ambiguous,
                 CASE WHEN s.ord % 9 = 0 THEN 1 ELSE 0 END AS c_multiple,
                 CASE WHEN (s.ord + t) % 13 = 0 THEN 2 ELSE 0 END AS c_special
          FROM {d.each("fx_sample s", 2, "t")}) j"""


def _label(d: Dialect) -> str:
    types = d.split(f"'{LABEL_TYPES}'", ",")
    return f"""
    SELECT g.*,
           CASE WHEN form = 0 THEN 'cannot classify'
                WHEN form = 1 THEN concat('{{"error_type": "other", "confidence": "', level, '", "explanation": "', lang, '"}}')
                WHEN form = 2 THEN concat('```json', chr(10), '{{"error_type": " ', upper(kind), '", "confidence": "', level,
                                          '", "explanation": "', lang, '"}}', chr(10), '```')
                ELSE concat('Answer: {{"error_type": "', kind, '", "confidence": "', upper(level), '", "reasoning": "', lang, '"}} done')
           END AS output
    FROM (SELECT s.ord, s.sample_id, s.lang, s.error_flag, concat('typer', {d.text("t")}) AS model,
                 CASE WHEN s.lang = 'es' AND s.quality IS NULL THEN 0
                      WHEN s.lang = 'fr' AND s.quality IS NULL THEN 1
                      WHEN s.lang = 'en' THEN 2 ELSE 3 END AS form,
                 CASE WHEN s.error_flag = 0 AND (s.ord + t) % 5 < 3 THEN 'none'
                      ELSE {d.nth(types, "CAST((s.ord + t) % 9 + 1 AS INT)")} END AS kind,
                 CASE (s.ord + t) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level
          FROM {d.each("fx_sample s", 2, "t")}) g"""


def _attempt(d: Dialect) -> str:
    """Run 0 asks for everything but some Spanish items and fails on German ones,
    run 1 asks again for what failed, and a copy has a name that is no stamp."""
    return f"""
    SELECT dataset, model, template,
           CASE WHEN r = 2 THEN 'backup_20240101' ELSE concat('20240101_00000', {d.text("r")}) END AS run_ts,
           ord, sample_id,
           CASE WHEN lost = 1 THEN '' ELSE content END AS content,
           CASE WHEN lost = 1 AND n_sentences > 5 THEN 'timeout' END AS error
    FROM (SELECT p.*, r, CASE WHEN lang = 'de' AND (r = 0 OR quality IS NULL) THEN 1 ELSE 0 END AS lost
          FROM {d.each("fx_response p", 3, "r")}) q
    WHERE (r = 0 AND NOT (lang = 'es' AND quality IS NULL)) OR (r = 1 AND lang = 'de') OR (r = 2 AND lang = 'fr')"""


def _reasoning(d: Dialect) -> str:
    return """
    SELECT doc_id, lang,
           CASE lang WHEN 'en' THEN concat('We are told that x holds. ', text, ' From Scratch it is fine. tail told that')
                     WHEN 'fr' THEN concat(text, ' This time we are reviewing one error with an example. The problem here', chr(10),
                                           'states that we do not care. The problem states: we do not care.')
                     WHEN 'de' THEN '' ELSE text END AS reasoning_en,
           CASE lang WHEN 'en' THEN concat('これは事前に確認した。', replace(text, '. ', '。'), '実際は問題ない。終わり')
                     WHEN 'fr' THEN concat(replace(text, '. ', '。'), '。今回は別のエラーを含む例だ。既に', chr(10),
                                           '全て分かった。既に全て分かっている。')
                     WHEN 'de' THEN '' ELSE replace(text, '. ', '。') END AS reasoning_ja
    FROM documents"""


def _think(d: Dialect) -> str:
    return """
    SELECT doc_id, a, b,
           CASE doc_id % 4 WHEN 0 THEN concat('<think>', a, '</think>', b)
                           WHEN 1 THEN concat(a, '</think>', b)
                           WHEN 2 THEN concat('pre <think>', a, '</think>', b, '</think>post')
                           ELSE concat(a, b) END AS raw_text
    FROM (SELECT doc_id, substr(text, 1, CAST(floor(length(text) / 2) AS INT)) AS a,
                 substr(text, CAST(floor(length(text) / 2) AS INT) + 1) AS b FROM documents) h"""


def _chat(d: Dialect) -> str:
    """Chat and item responses around a whole text."""
    t = d.json("text")
    return f"""
    SELECT doc_id, text,
           CASE doc_id % 7
                WHEN 0 THEN concat('{{"choices":[{{"message":{{"content":[{{"type":"text","text":"x"}},{{"type":"thinking","thinking":"', {t}, '"}}]}}}}]}}')
                WHEN 1 THEN concat('{{"choices":[{{"message":{{"content":[{{"type":"redacted_thinking"}},{{"type":"thinking","thinking":"', {t}, '"}}]}}}}]}}')
                WHEN 2 THEN concat('{{"choices":[{{"message":{{"content":"x","reasoning":"', {t}, '"}}}}]}}')
                WHEN 3 THEN concat('{{"choices":[{{"message":{{"content":"x","reasoning":"","reasoning_content":"', {t}, '"}}}}]}}')
                WHEN 4 THEN concat('{{"choices":[{{"reasoning":"', {t}, '","message":{{"content":"x"}}}}]}}')
                WHEN 5 THEN concat('{{"choices":[{{"reasoning_content":"', {t}, '","message":{{"content":"x"}}}}]}}')
                ELSE '{{"choices":[]}}' END AS chat,
           concat('{{"output":[{{"type":"message","text":"x"}},{{"type":"reasoning","summary":[{{"type":"summary_text","text":"first"}},',
                  '{{"type":"other","text":"no"}},{{"type":"summary_text","text":"', {t}, '"}}]}}]}}') AS items
    FROM documents"""


def _question(d: Dialect) -> str:
    return f"""
    SELECT doc_id AS ord, concat('n', {d.text("doc_id")}) AS question_id,
           CASE WHEN doc_id % 10 = 0 THEN concat('下線 部 ', text) ELSE text END AS question,
           CASE WHEN doc_id % 7 = 0 THEN '1' ELSE concat('opt a', {d.text("doc_id % 4")}) END AS c_a,
           CASE WHEN doc_id % 7 = 0 THEN '2' ELSE 'opt b' END AS c_b,
           CASE WHEN doc_id % 7 = 0 THEN '3' ELSE 'opt c' END AS c_c,
           CASE WHEN doc_id % 7 = 0 THEN '4' ELSE 'opt d' END AS c_d,
           CASE WHEN doc_id % 14 = 0 THEN '5' ELSE 'opt e' END AS c_e,
           substr('abcdef', CAST(doc_id % 6 + 1 AS INT), 1) AS answer, text, lang
    FROM documents"""


def _synth(d: Dialect) -> str:
    head = "### 選択肢{} から合成した {}"
    return f"""
    SELECT r.*,
           concat('{head.format("a", "Correct record")}', chr(10), '1. first ', story, chr(10), '2. **bold** two', chr(10),
                  '{head.format("b", "Error record")}', chr(10), '1. first b', chr(10), '2. bad two ', story, chr(10),
                  'エラータイプ: type', {d.text("ord % 6")}, chr(10),
                  CASE WHEN ord % 5 = 0 THEN '' ELSE concat('エラー文番号: 2', chr(10)) END,
                  'エラー文: bad two', chr(10), '修正文: good two', chr(10),
                  '{head.format("c", "Error record")}', chr(10), '1. only c', chr(10),
                  '{head.format("d", "Correct record")}', chr(10), '1. only d', chr(10),
                  CASE WHEN lang = 'en' THEN '' ELSE concat('{head.format("e", "Correct record")}', chr(10), '1. only e', chr(10)) END)
               AS content
    FROM (SELECT q.*, concat('synth', {d.text("ord % 2")}) AS model,
                 trim(replace(replace(replace(replace(text, chr(10), ' '), '#', ''), '**', ''), '選択肢', '')) AS story
          FROM fx_question q) r"""


_TABLES = {
    "fx_sample": (_sample, []),
    "fx_pred": (_pred, ["fx_sample"]),
    "fx_response": (_response, ["fx_pred"]),
    "fx_pair": (_pair, []),
    "fx_judge": (_judge, ["fx_sample"]),
    "fx_label": (_label, ["fx_sample"]),
    "fx_attempt": (_attempt, ["fx_response"]),
    "fx_reasoning": (_reasoning, []),
    "fx_think": (_think, []),
    "fx_chat": (_chat, []),
    "fx_question": (_question, []),
    "fx_synth": (_synth, ["fx_question"]),
}


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for need in [*_ordered(_TABLES[name][1]), name]:
            if need not in out:
                out.append(need)
    return out


def with_tables(names: list[str], query: str, dialect: Dialect = DUCK) -> str:
    """The query under a WITH clause of the tables it names."""
    if not names:
        return query
    ctes = [f"{n} AS ({dialect.spelled(_TABLES[n][0](dialect))})" for n in _ordered(names)]
    rest = query.lstrip()
    # A query with its own WITH continues the list.
    if rest[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {rest[5:]}"
    return f"WITH {', '.join(ctes)} {rest}"


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a text table out evenly, whatever its files and keys are.

    It belongs to the derivation of the tables below, not to the operators.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Tables:
    """The derived tables as DataFrames over one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in TEXTS else df

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" not in _TABLES:
            return self.base(name)
        sources = {b: self.base(b) for b in BASE}
        text = with_tables([f"fx_{name}"], f"SELECT * FROM fx_{name}", SPARK)
        # {name} marks are filled with the DataFrames by spark.sql; other braces are doubled.
        text = text.replace("{", "{{").replace("}", "}}")
        for b in BASE:
            text = text.replace(f"FROM {b}", f"FROM {{{b}}}").replace(f"JOIN {b}", f"JOIN {{{b}}}")
        used = {b: df for b, df in sources.items() if f"{{{b}}}" in text}
        return self.spark.sql(text, **used)
