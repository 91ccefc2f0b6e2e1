"""The registered queries of this subpackage and their SQL."""

from dialogmill.llm.bpe import op3_bpe
from dialogmill.llm.fingerprints import op1_fingerprints
from dialogmill.llm.langid import op10_langid
from dialogmill.llm.license_scan import OP6_SQL, op6_license_scan
from dialogmill.llm.merkle import OP13_SQL, op13_merkle
from dialogmill.llm.near_dedup import op8_near_dedup
from dialogmill.llm.packing import op7_packing
from dialogmill.llm.quality import op2_quality
from dialogmill.llm.quality_rules import OP5_SQL, op5_quality_rules
from dialogmill.llm.runs import op11_runs
from dialogmill.llm.suffix_dedup import op4_suffix_dedup
from dialogmill.llm.token_files import op12_token_files
from dialogmill.llm.warc import OP9_SQL, op9_warc


def queries():
    found = [op1_fingerprints, op2_quality, op3_bpe, op4_suffix_dedup, op5_quality_rules, op6_license_scan, op7_packing, op8_near_dedup, op9_warc, op10_langid, op11_runs, op12_token_files, op13_merkle]
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op5_quality_rules": OP5_SQL, "op6_license_scan": OP6_SQL, "op9_warc": OP9_SQL, "op13_merkle": OP13_SQL}
