"""Row positions, result shapes and the result cache."""
