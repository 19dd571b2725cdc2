"""Column functions; all of them stay inside the JVM."""

from .text import bytes_label, content_hash, escape_html, extension, highlight, pretokens, preview
from .vectors import axpy, cosine, cosine_or, dequantize, dot, norm, project, quantize, quantize_scale, sif_weight, without_component

__all__ = [
    "axpy", "bytes_label", "content_hash", "cosine", "cosine_or", "dequantize", "dot", "escape_html", "extension", "highlight", "norm", "pretokens", "preview", "project", "quantize", "quantize_scale", "sif_weight", "without_component",
]
