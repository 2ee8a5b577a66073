"""The registered queries of the operators, each over its whole table, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (
    clustering, fingerprints, html_extract, language, mixing, packing, quality, simhash, spelling,
    suffix_dedup, token_store, toxicity, url_filters,
)
from parley.llm.common import table


def fold(n: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"), passages=True)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(3) == 1
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out, held_out)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(5) == 0
    return language.predicted_languages(table(spark, sf_dir, "documents"), ~held_out, held_out)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered_vectors(table(spark, sf_dir, "embeddings"))


def op13_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_token_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_html_extraction, op3_suffix_dedup, op4_best_fit_packing, op5_quality_rules,
                                   op6_toxicity, op7_language_id, op8_fingerprints, op9_mixing, op10_simhash,
                                   op11_spelling_variants, op12_centroid_clustering, op13_token_store)}

_FITS = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"


def _rule_case(value) -> str:
    rules = sorted(url_filters.RULES, key=lambda r: -len(r.text))
    return "case " + " ".join(f"when {_FITS.format(h=r.host, p=r.path)} then '{value(r)}'" for r in rules)


def _quality_sql(rules: quality.QualityRules) -> str:
    """Base counts by lists, line frequency by (host, normalised line) over distinct texts."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
        with d as (select row_number() over () row_id, doc_id, coalesce(source, '') host, coalesce(md5(text), '') text_key,
                coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{word}') w from documents),
            lines as (select row_id, host, text_key, unnest(string_split(t, chr(10))) line from d),
            normal as (select row_id, host, text_key, line, lower(array_to_string(regexp_extract_all(line, '{word}'), ' ')) form,
                len(regexp_extract_all(line, '{word}')) words from lines where regexp_matches(line, '{word}')),
            often as (select host, form from normal join (select host, count(distinct text_key) host_docs from d group by host)
                using (host) group by host, form, host_docs having count(distinct text_key) > {rules.min_docs}
                and count(distinct text_key) > {rules.host_share}::double * host_docs),
            gone as (select row_id, sum(words) removed from normal join often using (host, form) group by row_id),
            dups as (select row_id, count(*) - count(distinct line) n from normal group by row_id),
            windows as (select row_id, unnest(range(1, len(w) - 1)) i, w from d where len(w) > 2),
            named as (select row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] name from windows),
            twice as (select row_id, name from named group by all having count(*) > 1),
            again as (select row_id, count(distinct place) n from (
                select row_id, unnest([i, i + 1, i + 2]) place from named join twice using (row_id, name)) group by row_id),
            counts as (select doc_id, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint
                word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, coalesce(dups.n, 0)::bigint n_dup_lines,
                coalesce(again.n, 0)::bigint n_repeat_words, coalesce(removed, 0)::bigint removed_words
                from d left join dups using (row_id) left join again using (row_id) left join gone using (row_id)),
            judged as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words
                as base_failed from counts)
        select *, not base_failed and n_words - removed_words >= {rules.min_kept_share}::double * n_words as kept from judged"""


def _mixing_sql(mix: mixing.Mix) -> str:
    """The mix in DuckDB SQL: leaf table, water filling level by level, each leaf's running sum in seeded order."""
    def weight(level: str) -> str:
        given = mix.weights.get(level, {})
        cases = " ".join(f"when {level} = '{k}' then {v}" for k, v in given.items())
        return f"case {cases} else 1 end" if cases else "1"

    def fill(name: str, nodes: str, parent: str, level: str) -> str:
        by = f"partition by {parent}" if parent else ""
        path = f"{parent}, {level}" if parent else level
        order = f"{by} order by cap::double / weight, {level}"
        return f"""{name}_a as (select *, coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0)
                before, sum(weight) over ({order} rows between current row and unbounded following) rest_weight
                from {nodes} where weight > 0),
            {name}_b as (select *, cap * rest_weight <= weight * (given - before) as sated from {name}_a),
            {name}_c as (select *, sum(case when sated then cap else 0 end) over ({by}) full_cap,
                sum(case when sated then 0 else weight end) over ({by}) open_weight from {name}_b),
            {name} as (select {path}, case when sated then cap else (weight * (given - full_cap)) // open_weight end::bigint
                as given from {name}_c)"""

    budget = (f"select {mix.budget_tokens}::bigint given" if mix.budget_tokens is not None
              else f"select (coalesce(sum(supply), 0) * {mix.budget_percent} // 100)::bigint given from leaf")
    return rf"""
        with unit as (select doc_id, coalesce(md5(text), '') text_key,
                'd' || translate(md5(coalesce(source, ''))[1:1], '0123456789abcdef', '0000111122223333') as domain,
                coalesce(lang, '') lang, coalesce(source, '') source,
                len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::bigint one, count(*) copies
                from documents group by all),
            leaf0 as (select domain, lang, source, sum(one * copies)::bigint supply from unit group by all),
            leaf as (select *, {weight('domain')} wd, {weight('lang')} wl, {weight('source')} ws from leaf0),
            caps as (select *, case when least(wd, wl, ws) > 0 then supply * {mix.max_epochs} else 0 end cap from leaf),
            top as ({budget}),
            n1 as (select domain, sum(cap)::bigint cap, max(wd) weight, max(top.given) given from caps, top group by all),
            {fill('g1', 'n1', '', 'domain')},
            n2 as (select domain, lang, sum(cap)::bigint cap, max(wl) weight, max(given) given
                from caps join g1 using (domain) group by all),
            {fill('g2', 'n2', 'domain', 'lang')},
            n3 as (select domain, lang, source, sum(cap)::bigint cap, max(ws) weight, max(given) given
                from caps join g2 using (domain, lang) group by all),
            {fill('g3', 'n3', 'domain, lang', 'source')},
            plan as (select domain, lang, source, given budget, given // supply whole, given % supply rest
                from g3 join leaf using (domain, lang, source) where supply > 0),
            drawn as (select *, md5('{mix.seed}:' || whole || ':' || coalesce(doc_id::varchar, '') || ':' || text_key) draw
                from unit join plan using (domain, lang, source) where one > 0),
            placed as (select *, coalesce(sum(one * copies) over (partition by domain, lang, source order by draw
                rows between unbounded preceding and 1 preceding), 0) as start from drawn),
            taken as (select *, whole + case when start < rest then 1 else 0 end times from placed)
        select doc_id, domain, lang, source, one as n_tokens, epoch, leaf_budget from (
            select doc_id, domain, lang, source, one, budget leaf_budget, copies,
                unnest(range(0, times::bigint)) as epoch from taken) t, range(0, copies)"""


def _spelling_sql() -> str:
    """Counted words, pairs by their deletions, forms, and roots by recursion."""
    crc = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        crc.append(c)

    def step(state: str, byte: str) -> str:
        return f"xor(({state}) >> 8, crcs[xor(({state}) & 255, {byte})::int + 1])"

    one, two = step("c", "x"), step(step("c", "195"), "x - 64")  # a letter from U+00C0 on is the bytes C3 and itself less 64
    points = "list_transform(string_split(id || ':' || run, ''), lambda y: unicode(y)::bigint)"
    return rf"""
        with crc as (select {crc}::bigint[] crcs),
            runs as (select coalesce(doc_id::varchar, '') id, unnest(regexp_extract_all(translate(text, '{url_filters.UPPER}',
                '{url_filters.LOWER}'), '[a-zÀ-ÿ]+')) run from documents),
            each as (select id, run, count(*) n from runs group by all),
            hashed as (select id, run, n, xor(list_reduce({points}, lambda c, x:
                case when x < 128 then {one} else {two} end, 4294967295::bigint), 4294967295::bigint) h from each, crc),
            seen as (select case when h % 97 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end word, n from hashed),
            vocab as materialized (select word, sum(n)::bigint n from seen where length(word) >= {spelling.MIN_LENGTH}
                group by word having sum(n) >= {spelling.MIN_COUNT}),
            cut as materialized (select word, i, word[:i - 1] || word[i + 1:] less from
                (select word, unnest(range(1, length(word) + 1)) i from vocab)),
            pair as materialized (select distinct a.word, b.word near from cut a join cut b on a.i = b.i and a.less = b.less and a.word <> b.word
                union select word, less from cut where less in (select word from vocab)
                union select less, word from cut where less in (select word from vocab)),
            best as (select p.word, count(*) n_near, first(struct_pack(near, n) order by n desc, near) best
                from pair p join vocab v on v.word = near group by p.word),
            judged as materialized (select word, n, coalesce(n_near, 0)::bigint n_near,
                case when best.n >= {spelling.RATIO} * vocab.n then best.near end form,
                case when best.n >= {spelling.RATIO} * vocab.n then best.n end form_n from vocab left join best using (word)),
            chain as (with recursive up(word, root) as (select word, form from judged where form is not null
                union all select up.word, j.form from up join judged j on j.word = up.root where j.form is not null)
                select up.word, root from up join judged j on j.word = up.root where j.form is null)
        select word, n, n_near, form, form_n, coalesce(root, word) root from judged left join chain using (word)"""


def _clustering_sql() -> str:
    """Plain rounds: every vector against every centroid, floors of exact means."""
    dim, k = clustering.DIM, clustering.K
    apart = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (v.p[i] - c.p[i]) * (v.p[i] - c.p[i])))"

    def nearest(t: int) -> str:
        return f"""a{t} as materialized (select rid, first(struct_pack(k := c.k, d := {apart}) order by {apart}, c.k) best
            from v, c{t} c group by rid)"""

    steps = []
    for t in range(clustering.ROUNDS):
        steps.append(f"""{nearest(t)},
            s{t} as (select k, i, sum(x) s, count(*) n from (select a.best.k k, unnest(p) x, unnest(range({dim})) i
                from v join a{t} a using (rid)) group by k, i),
            c{t + 1} as materialized (select c.k, coalesce(m.p, c.p) p from c{t} c left join (select k,
                list(((s - ((s % n) + n) % n) // n)::bigint order by i) p from s{t} group by k) m using (k))""")
    last = clustering.ROUNDS
    return f"""
        with v as materialized (select row_number() over () rid, vec_id, list_transform(embedding,
                lambda x: floor({clustering.SCALE} * x::double)::bigint) p from embeddings where len(embedding) = {dim}
                and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim}),
            h as (select p, sha256('{clustering.SEED}:' || coalesce(vec_id::varchar, '')) h from v),
            c0 as materialized (select row_number() over (order by h, p) - 1 k, p from h order by h, p limit {k}),
            {", ".join(steps)}, {nearest(last)},
            inertia as (select best.k k, sum(best.d)::bigint inertia from a{last} group by best.k)
        select vec_id, best.k::int as cluster, best.d::bigint as distance, i.inertia as cluster_inertia,
            (select sum(inertia)::bigint from inertia) as inertia, sha256(array_to_string(c.p, ',')) as centroid_sha256
        from v join a{last} a using (rid) join inertia i on i.k = a.best.k join c{last} c on c.k = a.best.k"""


ORACLES = {
    "op1_url_filters": f"""
        with u as (select page_id, case when position('://' in url) > 0
                          then substr(url, position('://' in url) + 3) else '' end rest from pages),
             v as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{url_filters.UPPER}',
                          '{url_filters.LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u)
        select page_id, host, path, {_rule_case(lambda r: r.text)} end as rule,
               {_rule_case(lambda r: r.verdict)} else 'allow' end as verdict from v""",
    "op5_quality_rules": _quality_sql(quality.RULES),
    "op9_mixing": _mixing_sql(mixing.MIX),
    "op11_spelling_variants": _spelling_sql(),
    "op12_centroid_clustering": _clustering_sql(),
}
