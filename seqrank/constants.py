"""Published scales and the weights of the scoring recipes."""

from __future__ import annotations

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
#: Ambiguous and rare codes and what stands for them when a sequence is cleaned.
REPLACED = ("BZUOJ", "NQCKL")
HYDROPHOBIC = "AILMFWVY"

# Hydropathy after Kyte and Doolittle (1982).
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}

# pKs after Bjellqvist et al. (1993, 1994), with those of terminal residues.
PK_POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
PK_NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_N_TERMINUS, PK_C_TERMINUS = 7.5, 3.55
PK_N_TERMINAL = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
PK_C_TERMINAL = {"D": 4.55, "E": 4.75}
#: The interval that holds an isoelectric point, where its bisection starts, and its steps (to a width of 1e-4).
PI_START, PI_LOW, PI_HIGH, PI_STEPS = 7.775, 4.05, 12.0, 17

# Average masses of free amino acids and of water, in Da.
MASS = {
    "A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729,
    "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445, "R": 174.201, "S": 105.0926, "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885,
}
WATER = 18.0153

# FNV-1a, 32 bits.
FNV_OFFSET, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 4294967295
KMER, KMER_DIM = 3, 4096

#: Robust z: MAD to standard deviation, and what keeps it off zero.
MAD_SCALE, MAD_FLOOR = 1.4826, 1e-8

# Weights of the cluster-aware recipe, by centred (c_) or global (g_) robust z.
R1_CORE = {"c_delta_ll": 1.7, "c_ll": 0.35, "g_ll": 0.20, "c_hydropathy": 0.55, "c_length": 0.60}
R1_CORE_LOCAL55 = -0.75
R1_DELTA = {"c_delta_emb": -0.9, "g_delta_emb": -0.2}
R1_ACTIVITY_1_MOTIF = -3.2
R1_ACTIVITY_2 = {"c_pg": 0.15}
R1_ACTIVITY_2_LOCAL90, R1_ACTIVITY_2_MOTIF = -0.55, -3.0
R1_EXPRESSION = {"c_delta_ll": 1.35, "c_ll": 0.25, "g_ll": 0.20, "c_hydropathy": -0.85, "c_pg": 0.55, "c_length": 0.65, "c_agg_window": -1.05, "c_agg_run": -0.95}
R1_EXPRESSION_DELTA = 0.40

# Weights of the final-parameter recipe, over robust z.
R2_ACTIVITY = {
    "safe": {"align": 1.0, "phopt": 0.7, "instability": -0.7, "delta": -0.8, "charge7": 0.15, "charge9": 0.10, "iep": 0.08},
    "aggressive": {"align": 1.3, "phopt": 0.9, "instability": -1.0, "delta": -1.2, "charge7": 0.25, "charge9": 0.15, "iep": 0.10},
}
R2_EXPRESSION = {
    "safe": {"instability": -1.0, "weight": -0.5, "delta": -0.4, "charge7": 0.15, "charge5": 0.08},
    "aggressive": {"instability": -1.4, "weight": -0.8, "delta": -0.6, "charge7": 0.25, "charge5": 0.10},
}
R2_SECOND, R2_SECOND_PHOPT, R2_CLIP = 0.98, 0.10, 25.0

# Mean and standard deviation of the profile composite's raw scores.
R3_SCALES = {
    "supervised": (0.528177376, 0.110047925),
    "family_hmm": (385.7173653, 37.75162564),
    "site_hmm": (38.39879032, 6.00236979),
    "homologs_hmm": (254.0185629, 21.75795843),
    "blosum": (-6127.99002, 53.01541192),
}

#: Length groups smaller than this aren't clustered; clusters by rows below a bound.
SMALL_GROUP = 100
CLUSTERS_BELOW = ((50, 2), (200, 3), (600, 5), (1500, 8))
CLUSTERS_MOST = 12
