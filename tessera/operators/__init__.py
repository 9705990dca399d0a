"""Set-oriented DataFrame operators and the Gibbs chains built on them."""
