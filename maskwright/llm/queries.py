"""One query per operator of this subpackage, over whole tables; SQL where it can say the same."""

from maskwright.llm.byte_bpe import op8_byte_bpe
from maskwright.llm.decontamination import op7_decontamination
from maskwright.llm.fingerprints import op10_fingerprints
from maskwright.llm.html_extraction import op3_html
from maskwright.llm.language import op5_language
from maskwright.llm.periodic_runs import op13_periodic_runs
from maskwright.llm.prefix_forest import op12_neighbours
from maskwright.llm.quality import op6_quality
from maskwright.llm.simhash import op2_simhash
from maskwright.llm.token_counts import op1_token_counts
from maskwright.llm.toxicity import op9_toxicity
from maskwright.llm.vector_codes import op11_vector_codes
from maskwright.llm.warc import op4_warc

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_html": op3_html,
    "op4_warc": op4_warc,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprints": op10_fingerprints,
    "op11_vector_codes": op11_vector_codes,
    "op12_neighbours": op12_neighbours,
    "op13_periodic_runs": op13_periodic_runs,
}

def vector_codes_sql(parts=8, entries=16, rounds=6):
    """Lloyd's rounds as one table after the other: the nearest entries, then their means."""
    books = [f"""
        book0 AS MATERIALIZED (
            SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, min(x) AS y FROM parts
            WHERE vec_id IN (SELECT DISTINCT vec_id FROM kept ORDER BY vec_id LIMIT {entries}) GROUP BY p, vec_id)"""]
    near = """
        near{0} AS MATERIALIZED (
            SELECT r, p, any_value(x) AS x, min(off) AS off, arg_min(e, off * 256 + e) AS e
            FROM (SELECT r, parts.p, x, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS off
                  FROM parts JOIN book{0} ON parts.p = book{0}.p)
            GROUP BY r, p)"""
    for k in range(rounds):
        books.append(near.format(k))
        books.append(f"""
        book{k + 1} AS MATERIALIZED (
            SELECT book{k}.p, book{k}.e, coalesce(mean, y) AS y FROM book{k} LEFT JOIN (
                SELECT p, e, list(mean ORDER BY i) AS mean FROM (
                    SELECT p, e, i, ((sum(x[i]) - (sum(x[i]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS mean
                    FROM near{k}, range(1, (SELECT any_value(len(x)) FROM parts) + 1) t(i) GROUP BY p, e, i)
                GROUP BY p, e) m ON m.p = book{k}.p AND m.e = book{k}.e)""")
    books.append(near.format(rounds))
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        parts AS MATERIALIZED (
            SELECT r, vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)),
        {','.join(books)},
        coded AS MATERIALIZED (
            SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(off)::BIGINT AS error FROM near{rounds} GROUP BY r)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(c, ',' ORDER BY p, e)) FROM (SELECT p, e, array_to_string(y, ',') AS c FROM book{rounds})) AS codebooks_sha256
        FROM kept JOIN coded USING (r)
    """


ORACLES = {
    "op11_vector_codes": vector_codes_sql(),
    # DuckDB's sha1 works on the text's bytes
    "op4_warc": """
        WITH records AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages),
        kept AS (
            SELECT payload_digest, max(page_id) AS kept FROM records WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, records.payload_digest,
            CASE WHEN kept > page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN kept > page_id THEN kept END AS refers_to
        FROM records LEFT JOIN kept ON kept.payload_digest = records.payload_digest AND payload_bytes >= 1000
    """,
}
