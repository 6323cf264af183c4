"""The queries of this package and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from tenderlake.llm.bpe_codec import op10_bpe_codec
from tenderlake.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from tenderlake.llm.language_id import op7_language_id
from tenderlake.llm.license_scan import op11_license_scan
from tenderlake.llm.media_sniff import op3_media_sniff
from tenderlake.llm.ordinal_quality import op1_quality_ordinal
from tenderlake.llm.packing import op9_best_fit_packing
from tenderlake.llm.periodic_runs import op12_periodic_runs
from tenderlake.llm.pii_crf import op2_pii_crf
from tenderlake.llm.ranked_search import OP13_SQL, op13_ranked_search
from tenderlake.llm.secret_scan import op4_secret_scan
from tenderlake.llm.simhash import op8_simhash_near_dedup
from tenderlake.llm.url_filter import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_quality_ordinal": op1_quality_ordinal,
    "op2_pii_crf": op2_pii_crf,
    "op3_media_sniff": op3_media_sniff,
    "op4_secret_scan": op4_secret_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_language_id": op7_language_id,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_license_scan": op11_license_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL = {
    "op5_exact_dedup": OP5_SQL,
    "op6_url_filter": OP6_SQL,
    "op13_ranked_search": OP13_SQL,
}
