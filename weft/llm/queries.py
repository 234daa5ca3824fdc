"""The queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from . import dedup, language, licenses, media, mixing, packing, pii, secrets, simhash, warc

QUERIES = {
    f.__name__: f
    for f in (
        secrets.op1_secret_ownership,
        warc.op2_warc_derivatives,
        packing.op3_harmonic_packing,
        pii.op4_weak_supervision,
        simhash.op5_simhash,
        language.op6_language_mixture,
        media.op7_signature_sniffing,
        mixing.op8_efraimidis_mixing,
        licenses.op9_license_diagonals,
        dedup.op10_dart_minhash,
    )
}
ORACLE_SQL = {"op1_secret_ownership": secrets.ORACLE_SQL, "op2_warc_derivatives": warc.ORACLE_SQL, "op8_efraimidis_mixing": mixing.ORACLE_SQL, "op10_dart_minhash": dedup.ORACLE_SQL}
