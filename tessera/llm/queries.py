"""Queries of the numbered operators and, where SQL can express them, their SQL."""

from . import audit, classifier, exact_dedup, html_extract, langid, mixing, packing, quality, search, sharding, simhash, url_filter, warc

QUERIES = {
    f.__name__: f
    for f in (packing.op1_pack, quality.op2_quality, langid.op3_language_id, html_extract.op4_html, exact_dedup.op5_exact_dedup, sharding.op6_shard, url_filter.op7_url_filter, mixing.op8_mix, warc.op9_warc, simhash.op10_simhash, search.op11_search, audit.op12_audit, classifier.op13_classify)
}
SQL = {"op5_exact_dedup": exact_dedup.SQL, "op7_url_filter": url_filter.SQL, "op8_mix": mixing.SQL, "op9_warc": warc.SQL, "op11_search": search.SQL, "op12_audit": audit.SQL}
