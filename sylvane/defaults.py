"""Settings and questions used where a command is given none."""

from __future__ import annotations

#: Default settings by section, as `readers.configured` takes them.
SETTINGS = {
    "SamplingConfig": {"selection_strategy": "kmeans", "n_select": 14, "k_neighbors": 30, "seed": 42},
    "TextEmbeddingConfig": {"chunk_size": 100, "overlap": 25},
    "NLIBatchingChukingConfig": {"chunk_size": 350, "overlap": 50, "max_characters_per_chunk": 2000},
    "LabelPropagationConfig": {"n_neighbors": 10, "sigma": 1.0, "alpha": 0.99, "max_iter": 100, "tol": 1e-3},
}

#: Statements that a page entails if it raises the problem.
PROBLEMS = {
    "compliance": "The text speaks of laws, rules or regulations that have to be kept.",
    "environmental_impact": "The text speaks of energy use, emissions or other effects on the environment.",
    "fairness": "The text speaks of bias, discrimination or unequal treatment of people.",
    "privacy_and_security": "The text speaks of personal data, privacy or the security of information.",
    "safety_and_robustness": "The text speaks of harm, failures or reliability of a system.",
    "transparency_and_explainability": "The text speaks of explaining or disclosing how a system works.",
}

#: Statements on how far a page goes into a problem that it raises.
DEPTHS = {
    "reflection": "The text reflects on the problem, its causes or its effects.",
    "solution": "The text proposes or describes a solution of the problem.",
}
