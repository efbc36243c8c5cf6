"""The registered queries of the training-data operators: thin layers over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresmith.session import table, written


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiresmith.llm.quality import fit_quality, score_quality
    from quiresmith.llm.sampling import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiresmith.llm.chat import format_conversations, loss_text, parse_formatted, text_parts

    own = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text")))
    out = format_conversations(rows.withColumn("parts", text_parts(F.col("text"))))
    out = out.withColumn("read", parse_formatted(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiresmith.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiresmith.llm.warc import archive, read_warc

    return read_warc(archive(table(spark, sf_dir, "pages")), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiresmith.llm.langid import fit_language, identify
    from quiresmith.llm.sampling import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = fit_language(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quiresmith.llm.tokenfile import token_file_round_trip

    return token_file_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, with_ids=False)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiresmith.llm.decontam import find_contamination, judged

    found = judged(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiresmith.llm.htmltree import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quiresmith.llm.bytebpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_payload=False)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiresmith.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _damaged(rows: DataFrame) -> DataFrame:
    """By crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes ends of sentences, 3 repeats it, 4 makes it the user's."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20).alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiresmith.llm.repair import conv_key, repair, repaired_hashes

    rows = table(spark, sf_dir, "conversations")
    report, repaired = repair(_damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("conv", conv_key(F.col("conv_id")))
    out = every.join(report, "conv", "left").join(repaired_hashes(repaired), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiresmith.llm.divergence import fit_references, judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, fit_references(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _shared_heads(turns: DataFrame) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % 20, and goes on with its own after its first h; h = crc32(c) % 4."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    base = F.col("conv_id") - F.col("conv_id") % 20
    plan = sizes.select("conv_id", base.alias("base"), F.when(F.col("conv_id") == base, 0).otherwise(F.crc32(F.col("conv_id").cast("string")) % 4).cast("long").alias("h"))
    heads = turns.where((F.col("conv_id") == base) & (F.col("pos") < 3)).withColumnRenamed("conv_id", "base").join(plan, "base").where("pos < h").select("conv_id", "pos", "label", "words")
    taken = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left").select("conv_id", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("taken"))
    own = turns.join(taken, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "label", "words")
    return heads.unionByName(own)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quiresmith.llm.trie import label_turns, prefix_trie

    turns = written(label_turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(_shared_heads(turns), turns.select("conv_id").distinct())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_chat_format": op2_chat_format,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_warc": op4_warc,
    "op5_language": op5_language,
    "op6_token_files": op6_token_files,
    "op7_decontaminate": op7_decontaminate,
    "op8_main_text": op8_main_text,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_topk": op10_topk,
    "op11_repair": op11_repair,
    "op12_divergence": op12_divergence,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op2_chat_format": r"""
        WITH all_turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), escaped AS (
            SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE\])|\|(?:image|audio|document):)', '\1\2\\\3', 'g'))
                    + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE\])|\|(?:image|audio|document):)', '\1\2\\\3', 'g'))
                    + length('<s>[ROLE][/ROLE]</s>') AS n
            FROM all_turns
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY conv_id""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
        hashed AS (SELECT *, array_to_string(list_transform(string_split(sha1(payload), ''), lambda c: substring('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', c) - 1) + 1, 4)), '') AS bits FROM p)
        SELECT page_id, strlen(payload) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substring(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substring(bits, 5 * i + 2, 1) AS INTEGER)
                   + 4 * CAST(substring(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substring(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substring(bits, 5 * i + 5, 1) AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
        FROM hashed""",
    "op10_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_repair": r"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        bits AS (SELECT *, list_transform(range(0, 8 * strlen(key)), lambda i: (ascii(substring(key, 1 + i // 8, 1)) >> (i % 8)) & 1) AS b FROM k),
        v AS (SELECT *, xor(list_reduce(list_prepend(4294967295, b), lambda s, x: xor(s >> 1, 3988292384 * (xor(s, x) & 1))), 4294967295) % 20 AS kind FROM bits),
        dam AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM v, LATERAL unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS u(copy) WHERE kind <> 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM dam),
        f AS (
            SELECT *, substring(role, 1, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
                   NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before, count(*) OVER (PARTITION BY conv_id) AS n FROM r
        ), steps AS (SELECT *, blank OR seen AS must, CASE WHEN NOT blank AND NOT seen AND open THEN 1 ELSE 0 END AS cut FROM f),
        way AS (
            SELECT conv_id, 0 AS pos, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM steps)
            UNION ALL
            SELECT conv_id, pos, state, w[1].cost, w[1].audit, w[1].lines FROM (
                SELECT conv_id, pos, state, list({'cost': cost, 'audit': audit, 'lines': lines} ORDER BY cost, audit) AS w FROM (
                    SELECT m.conv_id, m.pos + 1 AS pos, e.state, m.cost + e.cost AS cost, m.audit || e.letter AS audit, CASE WHEN e.letter = 'D' THEN m.lines ELSE list_append(m.lines, e.role || ':' || s.text) END AS lines
                    FROM (
                        SELECT conv_id, pos, state, cost, audit, lines FROM way
                        UNION ALL SELECT conv_id, pos, 2, cost + 2, audit || 'I', list_append(lines, 'user:') FROM way WHERE state <> 2
                        UNION ALL SELECT conv_id, pos, 3, cost + 2, audit || 'I', list_append(lines, 'assistant:') FROM way WHERE state = 2
                        UNION ALL SELECT conv_id, pos, 3, cost + 4, audit || 'II', list_concat(lines, ['user:', 'assistant:']) FROM way WHERE state IN (0, 1)
                    ) AS m JOIN steps AS s ON s.conv_id IS NOT DISTINCT FROM m.conv_id AND s.pos = m.pos,
                    LATERAL (
                        SELECT m.state, 3 AS cost, 'D' AS letter, '' AS role
                        UNION ALL SELECT CASE s.i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, s.cut, 'K', s.role WHERE NOT s.must AND ((s.i = 's' AND m.state = 0) OR (s.i = 'u' AND m.state <> 2) OR (s.i = 'a' AND m.state = 2))
                        UNION ALL SELECT CASE WHEN m.state = 2 THEN 3 ELSE 2 END, 2 + s.cut, 'R', CASE WHEN m.state = 2 THEN 'assistant' ELSE 'user' END WHERE NOT s.must
                    ) AS e
                ) GROUP BY conv_id, pos, state
            )
        ), ends AS (
            SELECT w.* FROM (
                SELECT conv_id, pos, cost, audit, lines FROM way WHERE state IN (0, 3)
                UNION ALL SELECT conv_id, pos, cost + 2, audit || 'I', list_append(lines, 'assistant:') FROM way WHERE state = 2
                UNION ALL SELECT conv_id, pos, cost + 4, audit || 'II', list_concat(lines, ['user:', 'assistant:']) FROM way WHERE state = 1
            ) AS w JOIN (SELECT DISTINCT conv_id, n FROM steps) AS z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.pos
        ), best AS (SELECT conv_id, list({'cost': cost, 'audit': audit, 'lines': lines} ORDER BY cost, audit)[1] AS w FROM ends GROUP BY conv_id),
        facts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut = 1) AS truncated,
                   count(*) FILTER (before IS NOT NULL AND (before || i) NOT IN ('su', 'ua', 'au')) AS illegal FROM steps GROUP BY conv_id
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(w.cost, 0) AS BIGINT) AS cost,
               coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
        one AS (SELECT r, lang, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
        tot AS (SELECT lang, count(*) AS n FROM one WHERE lang IS NOT NULL GROUP BY lang),
        big AS (SELECT lang, n FROM tot WHERE n >= (SELECT sum(n) FROM tot) / 100),
        cnt AS (SELECT lang, word, count(*) AS c FROM one JOIN big USING (lang) GROUP BY lang, word),
        com AS (SELECT word FROM cnt JOIN big USING (lang) GROUP BY word HAVING max(c / n) >= 1 / 256),
        ref AS (SELECT b.lang, m.word, coalesce(c, 0) / n AS q FROM big AS b CROSS JOIN com AS m LEFT JOIN cnt ON cnt.lang = b.lang AND cnt.word = m.word),
        hist AS (SELECT r, word, count(*) AS c FROM one JOIN com USING (word) GROUP BY r, word),
        bins AS (
            SELECT d.r, ref.lang, coalesce(c, 0) / len(words) AS p, q FROM d CROSS JOIN ref LEFT JOIN hist ON hist.r = d.r AND hist.word = ref.word WHERE len(words) > 0
            UNION ALL SELECT d.r, x.lang, 1 - coalesce(c, 0) / len(words), 1 - q FROM d CROSS JOIN (SELECT lang, sum(q) AS q FROM ref GROUP BY lang) AS x LEFT JOIN (SELECT r, sum(c) AS c FROM hist GROUP BY r) AS h ON h.r = d.r WHERE len(words) > 0
        ),
        wordly AS (SELECT r, lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS far FROM bins GROUP BY r, lang),
        c1 AS (SELECT r, lang, t, regexp_replace(t, '\p{Ll}', '', 'g') AS t1 FROM d), c2 AS (SELECT *, regexp_replace(t1, '[\x20\x09-\x0D]', '', 'g') AS t2 FROM c1), c3 AS (SELECT *, regexp_replace(t2, '\p{Lu}', '', 'g') AS t3 FROM c2),
        c4 AS (SELECT *, regexp_replace(t3, '[.,;:!?''"()-]', '', 'g') AS t4 FROM c3), c5 AS (SELECT *, regexp_replace(t4, '[0-9]', '', 'g') AS t5 FROM c4), c6 AS (SELECT *, regexp_replace(t5, '\p{L}', '', 'g') AS t6 FROM c5),
        sizes AS (SELECT r, lang, length(t) AS n, [length(t) - length(t1), length(t1) - length(t2), length(t2) - length(t3), length(t3) - length(t4), length(t4) - length(t5), length(t5) - length(t6), length(t6)] AS c FROM c6),
        class AS (SELECT r, lang, n, unnest(c) AS c, generate_subscripts(c, 1) AS k FROM sizes),
        kind AS (SELECT lang, k, sum(c) / sum(class.n) AS q FROM class JOIN big USING (lang) GROUP BY lang, k),
        classy AS (SELECT r, kind.lang, sqrt(greatest(0, sum(CASE WHEN c > 0 THEN c / n * log2(2 * (c / n) / (c / n + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (c / n + q)) ELSE 0 END) / 2)) AS far FROM class JOIN kind USING (k) WHERE n > 0 GROUP BY r, kind.lang),
        near AS (
            SELECT d.r, bool_or((len(words) < 50 OR w.far * w.far <= 0.27 * 0.27 + 0.06 * (SELECT count(*) FROM com) / len(words)) AND (length(t) < 200 OR c.far <= 0.25)) AS near
            FROM d JOIN wordly AS w ON w.r = d.r JOIN classy AS c ON c.r = d.r AND c.lang = w.lang GROUP BY d.r
        ),
        win AS (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM (SELECT r, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda j: array_to_string(words[j:j + 4], ' '))) AS w FROM d WHERE len(words) > 5)),
        again AS (SELECT r, count(DISTINCT i + k) AS n FROM win, LATERAL unnest(range(0, 5)) AS t(k) WHERE n > 1 GROUP BY r),
        base AS (
            SELECT d.r, doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN again ON again.r = d.r
        )
        SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words,
               n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words AND coalesce(near, true) AS kept
        FROM base LEFT JOIN near ON near.r = base.r""",
    "op13_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                   {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (SELECT c, list(x ORDER BY pos) AS turns FROM t GROUP BY c),
        bits AS (SELECT c, list_transform(range(0, 8 * strlen(CAST(c AS VARCHAR))), lambda i: (ascii(substring(CAST(c AS VARCHAR), 1 + i // 8, 1)) >> (i % 8)) & 1) AS b FROM own),
        plan AS (SELECT c, CASE WHEN c % 20 = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, b), lambda s, v: xor(s >> 1, 3988292384 * (xor(s, v) & 1))), 4294967295) % 4 END AS h FROM bits),
        rebuilt AS (SELECT own.c, list_concat(coalesce(base.turns, [])[1:h], own.turns[h + 1:]) AS turns FROM own JOIN plan ON plan.c = own.c LEFT JOIN own AS base ON base.c = own.c - own.c % 20),
        member AS (SELECT c, d, turns[1:d] AS key, len(turns) = d AS ends FROM rebuilt, LATERAL unnest(range(0, len(turns) + 1)) AS u(d)),
        node AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends)), sha256('')) AS ends_sha256 FROM member GROUP BY key, d),
        full_node AS (
            SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM node AS k WHERE k.d = n.d + 1 AND k.key[1:n.d] = n.key) AS n_children,
                   CASE WHEN n.d > 0 THEN (n.n_convs - 1) * len(regexp_extract_all(n.key[n.d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own
            FROM node AS n LEFT JOIN node AS p ON p.d = n.d - 1 AND p.key = n.key[1:n.d - 1]
        ), below AS (SELECT key[1:a] AS key, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM full_node, LATERAL unnest(range(0, d + 1)) AS u(a) GROUP BY ALL)
        SELECT conv_id, f.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM full_node AS f JOIN below AS b ON b.d = f.d AND b.key = f.key""",
}
