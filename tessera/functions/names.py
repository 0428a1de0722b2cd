"""Roles, layers and patterns of tensor names (inventory C116-C134)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any(name: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | name.contains(p)
    return out


def _cascade(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = None
    for label, rule in rules:
        out = F.when(rule, label) if out is None else out.when(rule, label)
    return out.otherwise(otherwise)


def tensor_role(name: Column) -> Column:
    """One of 17 roles; rules run from special to general and the first one counts."""
    n = F.lower(name)
    return _cascade(
        [
            ("Embedding", n.contains("embed")),
            ("LmHead", n.contains("lm_head") | (n == "head.weight") | n.endswith(".head.weight")),
            ("Mtp", n.startswith("mtp.") | n.contains(".mtp.")),
            ("HyperConnection", n.contains("hc_")),
            ("Norm", _any(n, "layernorm", "rms_norm") | n.endswith("norm.weight")),
            ("AttentionIndexer", _any(n, "indexer", "weights_proj", "wk.")),
            ("MoeRouter", _any(n, "mlp.gate", "ffn.gate", "router")),
            ("MoeSharedExpert", n.contains("shared_experts")),
            ("MoeRoutedExpert", n.contains("experts.")),
            ("AttentionQuery", _any(n, "q_a_proj", "q_b_proj", "wq_a", "wq_b", "q_proj")),
            ("AttentionKey", _any(n, "kv_a_proj", "kv_b_proj", "wkv", "k_proj")),
            ("AttentionValue", n.contains("v_proj") & ~n.contains("kv_")),
            ("AttentionOutput", _any(n, "o_proj", "wo_a", "wo_b")),
            ("MlpGate", n.contains("gate_proj")),
            ("MlpUp", n.contains("up_proj")),
            ("MlpDown", n.contains("down_proj")),
            ("MlpUp", n.endswith(".w1") | n.endswith("w1.weight")),
            ("MlpDown", n.endswith(".w2") | n.endswith("w2.weight")),
            ("MlpGate", n.endswith(".w3") | n.endswith("w3.weight")),
        ],
        "Other",
    )


def structural_role(name: Column) -> Column:
    """Eight-way role for structural counts; case matters."""
    return _cascade(
        [
            ("attention", _any(name, "self_attn", "attention")),
            ("mlp", _any(name, "mlp", "ffn")),
            ("embedding", name.contains("embed")),
            ("normalization", name.contains("norm")),
            ("lm_head", name.contains("lm_head")),
            ("mlp", _any(name, "gate", "up", "down")),
            ("attention", _any(name, "q_proj", "k_proj", "v_proj", "o_proj")),
        ],
        "other",
    )


def physical_type(name: Column) -> Column:
    """Ten-way type for byte totals; case matters."""
    return _cascade(
        [
            ("attention_qkv", _any(name, "q_proj", "k_proj", "v_proj")),
            ("attention_output", name.contains("o_proj")),
            ("mlp_gate", name.contains("gate_proj")),
            ("mlp_up", name.contains("up_proj")),
            ("mlp_down", name.contains("down_proj")),
            ("embedding", name.contains("embed_tokens")),
            ("lm_head", name.contains("lm_head")),
            ("normalization", name.contains("norm")),
            ("bias", name.contains("bias")),
        ],
        "other",
    )


def _number_after(name: Column, *marks: str) -> Column:
    """Digits right after the first place of each mark; the first mark that has some counts."""
    found = [F.regexp_extract(name, f"^.*?{re.escape(m)}([0-9]*)", 1) for m in marks]
    return F.coalesce(*[F.when(x != "", x.try_cast("bigint")) for x in found])


def layer_number(name: Column) -> Column:
    return _number_after(name, "layers.", "layer.")


def expert_number(name: Column) -> Column:
    return _number_after(name, "experts.", "expert.")


def named_dimension(name: Column, shape: Column) -> Column:
    """For matrices: an array of (key, value) of the dimension that the name tells."""
    d0, d1 = F.get(shape, F.lit(0)), F.get(shape, F.lit(1))
    key = (
        F.when(_any(name, "q_proj", "k_proj", "v_proj"), "attention_dim")
        .when(name.contains("o_proj"), "output_dim")
        .when(_any(name, "gate_proj", "up_proj"), "mlp_intermediate")
        .when(name.contains("down_proj"), "mlp_output")
        .when(name.contains("embed_tokens"), "embed_dim")
        .when(name.contains("lm_head"), "lm_head_dim")
    )
    one = F.struct(key.alias("key"), d0.alias("value"))
    two = F.struct(F.lit("vocab_size").alias("key"), d1.alias("value"))
    none = F.array().cast("array<struct<key:string,value:bigint>>")
    both = F.when(key == "embed_dim", F.array(one, two)).when(key.isNotNull(), F.array(one)).otherwise(none)
    return F.when(F.size(shape) == 2, both).otherwise(none)


# Architecture class and its label.
ARCHITECTURES = {
    "GlmMoeDsaForCausalLM": "Transformer + MoE + DSA",
    "GlmMoeDsaModel": "Transformer + MoE + DSA",
    "DeepseekV4ForCausalLM": "Transformer + MoE + MLA",
    "DeepseekV4Model": "Transformer + MoE + MLA",
    "LlamaForCausalLM": "Transformer + LLaMA",
    "LlamaModel": "Transformer + LLaMA",
    "MistralForCausalLM": "Transformer + Mistral",
    "MistralModel": "Transformer + Mistral",
    "GPT2LMHeadModel": "Transformer + GPT-2",
    "GPT2Model": "Transformer + GPT-2",
    "BertForMaskedLM": "Transformer + BERT",
    "BertModel": "Transformer + BERT",
}


def architecture_type(architectures: Column) -> Column:
    """Label of the first known class in a list."""
    from tessera.functions.dtypes import lookup

    labels = F.filter(F.transform(architectures, lambda a: lookup(ARCHITECTURES, a)), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(labels, F.lit(1)), F.lit("Transformer"))


def pattern_regex(pattern: str) -> str:
    """A name pattern as an anchored expression; ``{x}`` stands for one or more dotted parts."""
    if "{" not in pattern:
        return ".*" + re.escape(pattern) + ".*"
    parts = ["[^.]*(\\.[^.]*)*" if p.startswith("{") and p.endswith("}") else re.escape(p) for p in pattern.split(".")]
    return "^" + "\\.".join(parts) + "$"


def matches(name: Column, pattern: str) -> Column:
    """Substring without placeholders, else a match of dotted parts."""
    return name.contains(pattern) if "{" not in pattern else name.rlike(pattern_regex(pattern))


def layer_tensor(template: str, *values: Column) -> Column:
    """Fill ``{}`` places of a template from left to right."""
    bits = template.split("{}")
    out = [F.lit(bits[0])]
    for v, b in zip(values, bits[1:]):
        out += [v.cast("string"), F.lit(b)]
    return F.concat(*out)


def routed_expert(layer: Column, expert: Column, projection: str, numbered: bool = False) -> Column:
    """Name of a routed expert's matrix: ``ffn`` with w1/w3/w2, or ``mlp`` with up/gate/down projections."""
    if numbered:
        return layer_tensor("layers.{}.ffn.experts.{}." + {"up": "w1", "gate": "w3", "down": "w2"}[projection] + ".weight", layer, expert)
    return layer_tensor("model.layers.{}.mlp.experts.{}." + projection + "_proj.weight", layer, expert)


def shared_expert(layer: Column, projection: str, numbered: bool = False) -> Column:
    if numbered:
        return layer_tensor("layers.{}.ffn.shared_experts." + {"up": "w1", "gate": "w3", "down": "w2"}[projection] + ".weight", layer)
    return layer_tensor("model.layers.{}.mlp.shared_experts." + projection + "_proj.weight", layer)


# What a tensor role is called in reports.
ROLE_LABELS = {
    "Embedding": "embeddings", "AttentionQuery": "attention Q", "AttentionKey": "attention K", "AttentionValue": "attention V",
    "AttentionOutput": "attention O", "MlpUp": "MLP up", "MlpGate": "MLP gate", "MlpDown": "MLP down", "MoeRouter": "routeur MoE",
    "MoeSharedExpert": "expert partagé", "MoeRoutedExpert": "expert routé", "Norm": "normalisation", "LmHead": "tête de langage", "Mtp": "MTP",
    "HyperConnection": "hyper-connexion", "AttentionIndexer": "indexeur d'attention", "Other": "autre",
}


def role_label(role: Column) -> Column:
    """Display label of a tensor role; unknown roles are ``autre``."""
    pairs = F.create_map(*[F.lit(x) for kv in ROLE_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, role), F.lit(ROLE_LABELS["Other"]))
