"""Training-data operators: each module holds one operator; ``registry`` holds the thin queries."""
