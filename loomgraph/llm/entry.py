"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .automaton import op9_automaton
from .bpe import op1_bpe
from .chat import op7_chat
from .decontaminate import op4_decontaminate
from .masked_lm import op3_masked_lm
from .oracles import OP5, OP6, OP7, OP9
from .quality import op2_quality
from .radix import op6_radix
from .secrets import op5_secrets
from .simhash import op10_simhash
from .toxicity import op8_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_masked_lm": op3_masked_lm,
    "op4_decontaminate": op4_decontaminate,
    "op5_secrets": op5_secrets,
    "op6_radix": op6_radix,
    "op7_chat": op7_chat,
    "op8_toxicity": op8_toxicity,
    "op9_automaton": op9_automaton,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {
    "op5_secrets": OP5,
    "op6_radix": OP6,
    "op7_chat": OP7,
    "op9_automaton": OP9,
}
