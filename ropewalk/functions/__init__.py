from .parsing import (is_hard, parse_chain, parse_fragments, parse_id_list, rule_step,
                      rule_stats, type_key)
from .scoring import (avg_pos, skill_heat, success_rate, time_decay, token_efficiency, trials,
                      utility)
from .text import (bm25_text, canon_id, est_tokens, loaded_tokens, paragraphs, section_name,
                   slugify, tokens, trace_cut, vector_text, ws_tokens)
from .vectors import cosine, hash_bucket, hash_embed

__all__ = [
    "avg_pos", "bm25_text", "canon_id", "cosine", "est_tokens", "hash_bucket", "hash_embed",
    "is_hard", "loaded_tokens", "paragraphs", "parse_chain", "parse_fragments", "parse_id_list",
    "rule_stats", "rule_step", "section_name", "skill_heat", "slugify", "success_rate",
    "time_decay", "token_efficiency", "tokens", "trace_cut", "trials", "type_key", "utility",
    "vector_text", "ws_tokens",
]
