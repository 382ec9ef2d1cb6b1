"""Graph, embedding and statistics operators."""
