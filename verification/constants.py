"""Values the SQL needs, written down apart from the engine so that a wrong one there is noticed."""

from __future__ import annotations

import math

# Function words, in the order they are listed for the study.
EN_FUNCTION_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "than", "that", "this", "these", "those", "to", "of", "in", "on", "at", "for", "from", "with",
    "by", "as", "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "have", "has", "had", "will", "would", "can", "could",
    "should", "may", "might", "must", "not", "no", "nor", "it", "its", "they", "them", "their", "he", "she", "we", "you", "i", "me", "my", "our",
    "your",
)
FR_FUNCTION_WORDS = (
    "le", "la", "les", "un", "une", "des", "de", "du", "et", "ou", "mais", "donc", "or", "ni", "car", "a", "au", "aux", "en", "dans", "sur", "sous",
    "pour", "par", "avec", "sans", "ce", "cet", "cette", "ces", "je", "tu", "il", "elle", "nous", "vous", "ils", "elles", "me", "te", "se", "ne",
    "pas", "est", "sont", "etait", "etre", "avoir", "ont", "que", "qui", "quoi", "dont",
)


def response_kernel(rate: float) -> list[float]:
    """Double-gamma response over 32 s at ``rate`` samples a second, summing to 1: g(6) - 0.35 g(12) with scale 0.9, shifted by a sample."""
    count = round(32 * rate)

    def gamma(t: float, mean: float) -> float:
        shape, x = mean / 0.9, t / 0.9
        return math.exp((shape - 1) * math.log(x) - x - math.lgamma(shape)) / 0.9 if x > 0 else 0.0

    values = [gamma(t, 6.0) - 0.35 * gamma(t, 12.0) for t in (32.0 * i / (count - 1) - 1 / rate for i in range(count))]
    return [v / math.fsum(values) for v in values]
