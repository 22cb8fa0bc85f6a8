"""The queries of this package, by name."""

from __future__ import annotations

from .bpe import op6_byte_bpe
from .divergence import ORACLE as DIVERGENCE
from .divergence import op11_divergence
from .html_extract import op1_html
from .lm import op5_lm
from .media import op10_media
from .packing import op8_packing
from .quality import op2_quality
from .repetition import op12_repetition
from .secrets import op7_secrets
from .sharding import op4_sharding
from .simhash import op3_simhash
from .sketches import op9_fingerprints
from .spelling import op13_spelling

QUERIES = {
    f.__name__: f
    for f in (
        op1_html,
        op2_quality,
        op3_simhash,
        op4_sharding,
        op5_lm,
        op6_byte_bpe,
        op7_secrets,
        op8_packing,
        op9_fingerprints,
        op10_media,
        op11_divergence,
        op12_repetition,
        op13_spelling,
    )
}

#: The others cannot be said in SQL alone: they need XXH64, CRC-32, tokenizers or iteration.
ORACLE_SQL: dict[str, str] = {"op11_divergence": DIVERGENCE}
