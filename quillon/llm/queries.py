"""The operators as queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name: module of quillon.llm that has a function of this name.
MODULES = {
    "op1_token_output": "token_output",
    "op2_embedding_dedup": "embed_dedup",
    "op3_minhash": "minhash",
    "op4_quality_rules": "quality_rules",
    "op5_warc": "warc",
    "op6_perplexity": "perplexity",
    "op7_pieces": "pieces",
    "op8_toxicity": "toxicity",
    "op9_mixing": "mixing",
    "op10_language": "language",
    "op11_divergence": "divergence",
    "op12_chat": "chat",
    "op13_filter_audit": "filter_audit",
}


def queries() -> dict:
    """The queries; each module is imported with them, so that a missing library shows here and not within a job."""
    return {name: getattr(importlib.import_module(f"quillon.llm.{module}"), name) for name, module in MODULES.items()}


#: component_id of `ids` (id) that `links` (a, b, both directions) connect.
_COMPONENTS = """reach as (select id, id r from ids union select reach.id, links.b from reach join links on links.a = reach.r), parts as (select id, min(r) component_id from reach group by 1)"""

#: Upper-case base32 of a digest in hexadecimal digits: five of them are four characters.
_BASE32 = "list_reduce(flatten(list_transform(range(0, 8), lambda g: list_transform([15, 10, 5, 0], lambda s: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substring({0}, 5 * g + 1, 5))::int >> s) & 31) + 1, 1)))), lambda a, b: a || b)"


def oracle_sql() -> dict[str, str]:
    """Operators 2, 3, 5, 11, 12 and 13. The others hold what DuckDB can't express (vocabularies, learnt models, Spark's hashes): tests hold
    them against libraries, plain versions and held-out labels."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {
        "op2_embedding_dedup": f"""with recursive v as (select vec_id id, embedding::double[] e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
            links as (select x.id a, y.id b from v x join v y on x.id <> y.id and len(x.e) = len(y.e) where list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.9),
            ids as (select vec_id id from embeddings), {_COMPONENTS}
            select id vec_id, (select count(*) from links where a = parts.id) n_links, component_id, component_id = id kept from parts""",
        "op3_minhash": f"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[ \t-\r]+'), lambda x: x <> '') w from documents),
            s as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) s from w),
            n as (select doc_id, count(*) n from s group by 1), common as (select x.doc_id a, y.doc_id b, count(*) k from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
            links as (select a, b from common join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 85 * (p.n + q.n - k)), ids as (select doc_id id from documents), {_COMPONENTS}
            select id doc_id, coalesce(n, 0) n_shingles, component_id, component_id = id kept from parts left join n on n.doc_id = id""",
        "op5_warc": f"""select page_id, b payload_bytes, {_BASE32.format('h')} payload_digest, case when page_id = f then 'response' else 'revisit' end record_type, case when page_id <> f then f end refers_to
            from (select *, min(page_id) over (partition by h, b) f from (select page_id, sha1(encode(coalesce(html, ''))) h, octet_length(encode(coalesce(html, ''))) b from pages))""",
        "op11_divergence": f"""with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') w from documents),
            g as (select distinct lang, source from d), o as (select r, lang, source, unnest(w) term from d),
            kept as (select lang, term from o group by 1, 2 having count(distinct r) >= 30),
            c as (select o.lang, o.source, o.term, count(*) n from o join kept k on k.lang = o.lang and k.term = o.term group by 1, 2, 3),
            v as (select lang, count(*) v from kept group by 1), gn as (select lang, source, sum(n) n from c group by 1, 2), ln as (select lang, sum(n) n from c group by 1), lc as (select lang, term, sum(n) n from c group by 1, 2),
            p as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(gn.n, 0) + 5 * v.v) p from g join kept k on k.lang = g.lang join v on v.lang = g.lang left join gn on gn.lang = g.lang and gn.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
            q as (select lc.lang, lc.term, 1 + (1000000000::hugeint * (lc.n + 5)) // (ln.n + 5 * v.v) q from lc join ln on ln.lang = lc.lang join v on v.lang = lc.lang),
            f as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
            pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f.value, 0) value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
            over_all as (select p.lang, p.source, 'term' part, p.term item, p.p - q.q value from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q)
            select lang, source, part, item, value::bigint value, rank::int rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) rank from (select * from pairs union all select * from over_all)) where part = 'pair' or rank <= 50""",
        "op12_chat": r"""with t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text, turn t, role r, text x from conversations union all select -1, k, ['user', 'assistant'][k + 1], s, k, ['user', 'assistant'][k + 1], s from (select unnest([0, 1]) k, '<|im_end|><|im_start|>assistant ok' s))
            select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by t nulls first, r nulls first, x nulls first)) turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
            sha256(coalesce(string_agg(text, '' order by t nulls first, r nulls first, x nulls first) filter (role = 'assistant'), '')) loss_sha256, sum(length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 32)::bigint formatted_chars from t group by conv_id""",
        "op13_filter_audit": """with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') w from documents),
            l as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by 1), e as (select t, min(doc_id) first from d group by 1),
            f as (select part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 2 * length(d.t))::int + 8 * regexp_matches(d.t, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > first, false)::int m, coalesce(good, 0) good, coalesce(toxic, 0) toxic from d join e on e.t = d.t left join l on l.doc_id = d.doc_id),
            c as (select part, m, count(*) n, sum(good) good, sum(toxic) toxic from f group by 1, 2), x as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
            o as (select a.x || b.x || c.x || d.x || e.x o from x a, x b, x c, x d, x e where a.x <> b.x and c.x not in (a.x, b.x) and d.x not in (a.x, b.x, c.x) and e.x not in (a.x, b.x, c.x, d.x)),
            s as (select o filter_order, step, 1 << (ascii(substr(o, step, 1)) - 65) bit, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(o, i, 1)) - 65))), 0)::int before from o, (select unnest(range(1, 6))::int step)),
            r as (select part, filter_order, step, bit, coalesce(sum(n) filter (m & (bit | before) = 0), 0)::bigint kept, coalesce(sum(n) filter (m & bit > 0 and m & before = 0), 0)::bigint removed, coalesce(sum(n) filter (m & bit > 0 and m & before > 0), 0)::bigint redundant, coalesce(sum(n) filter (m = bit), 0)::bigint unique_fails, coalesce(sum(good) filter (m & bit > 0 and m & before = 0), 0)::bigint good_lost, coalesce(sum(toxic) filter (m & bit > 0 and m & before = 0), 0)::bigint toxic_lost from c, s group by 1, 2, 3, 4)
            select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint shapley from r""",
    }
