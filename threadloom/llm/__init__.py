"""Training-data operators: each module holds one operator with a general
interface; ``registry`` derives the contract queries from them."""
